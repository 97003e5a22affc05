"""One consistent form for text that looks the same (problem 5).

DuckDB runs inside the Arrow partitions: `translate` maps compatibility forms, widths of space and look-alike
letters, regular expressions drop invisible characters and order accents, and `nfc_normalize` composes. What a
reader can see stays: case, missing accents, superscripts, punctuation, number of spaces, line breaks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

# Characters and the character that they look like.
SPACES = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԀԚԜаеорсухѕіјԁһӏԛԝёїЁЇ", "ABESIJKMHOPCTYXYDQWaeopcyxsijdhlqwëïËÏ")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοϲϳ", "ABEZHIKMNOPTYXCJocj")
LATIN = ("ɑɡⱭꞬÐƉ", "agAGĐĐ")
ARMENIAN = ("օՕ", "oO")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ")
LISU = ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ")
SIGNS = ("‐‑ʼ￠￡￢￥￦", "--’¢£¬¥₩")
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E007F}]+"
TONES = "\u0300\u0301\u0303\u0309"
SHAPES = {"\u0302": "aeoAEO", "\u0306": "aA"}
#: Kinds of compatibility character that read as plain letters, digits and units; superscripts, fractions, circled ones
#: and the like differ to the eye.
ALIKE_KINDS = ("<wide>", "<narrow>", "<font>", "<compat>", "<square>")


def compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Compatibility characters by the public Unicode data: those of one plain character, and those of several.

    Only widths, type faces, ligatures, numerals and units count, and only where the plain form is letters, digits,
    marks or ASCII signs of full width: a letter of another script is never the plain form of punctuation.
    """
    single, several = {}, {}
    for code in range(0xA0, 0x20000):
        char = chr(code)
        kind = unicodedata.decomposition(char).split(" ", 1)[0]
        plain = unicodedata.normalize("NFKC", char)
        if kind not in ALIKE_KINDS or char == "ſ":
            continue
        if kind in ("<wide>", "<narrow>") and len(plain) == 1 and plain.isascii():
            single[char] = plain
        elif len(plain) == 1 and unicodedata.category(plain)[0] in "LNM":
            single[char] = plain
        elif code < 0x1F000 and all(unicodedata.category(c)[0] in "LM" or c == "°" for c in plain):
            several[char] = plain
    return single, several


def ranges(chars) -> str:
    """A regular expression's class of characters."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_SINGLE, SEVERAL = compatible()
_PAIRS = (CYRILLIC, GREEK, LATIN, ARMENIAN, CHEROKEE, LISU, SIGNS, (SPACES, " " * len(SPACES)))
_BY_HAND = dict(zip(*("".join(side) for side in zip(*_PAIRS, strict=True)), strict=True))
#: A plain form may itself have a look-alike (a bold Greek capital), so it is mapped through once more.
SINGLE = {char: _BY_HAND.get(plain, plain) for char, plain in _SINGLE.items() if char not in _BY_HAND} | _BY_HAND
SEVERAL = {char: "".join(_BY_HAND.get(c, c) for c in plain) for char, plain in SEVERAL.items()}
#: The common ones are mapped in every text; a text with a rarer one goes through the whole table.
COMMON = _BY_HAND | dict(zip(WIDE, (chr(0x21 + i) for i in range(94)), strict=True))
RARE = ranges({*SINGLE, *SEVERAL} - {*COMMON})

#: Texts are handed to DuckDB in slices of about this many bytes, so that very long texts don't pile up.
SLICE_BYTES = 4_000_000


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str, rare: Iterable[str] | None = None) -> str:
    """The DuckDB expression for the consistent form of a column: a key for comparing texts, not a text to train on.

    `rare` names the rarer characters that the column holds, all that are known by default; with fewer of them the
    expression is shorter.
    """
    rare = [c for c in (*SINGLE, *SEVERAL) if c not in COMMON] if rare is None else sorted(rare)
    table = COMMON | {c: SINGLE[c] for c in rare if c in SINGLE}
    mapped = f"translate(regexp_replace({column}, '{INVISIBLE}', '', 'g'), {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"
    for sign in rare:
        if sign in SEVERAL:
            mapped = f"replace({mapped}, '{sign}', '{SEVERAL[sign]}')"
    # Accents of one combining class keep their written order under NFC: put the shape before the tone.
    swapped = f"regexp_replace({mapped}, '([{TONES}])([\u031b\u0323]?)([{''.join(SHAPES)}])', '\\3\\2\\1', 'g')"
    composed = f"nfc_normalize({swapped})"
    late = composed
    for shape, letters in SHAPES.items():
        for letter in letters:
            for tone in TONES:
                late = f"replace({late}, nfc_normalize('{letter}{tone}') || '{shape}', nfc_normalize('{letter}{shape}{tone}'))"
    return f"CASE WHEN regexp_matches({composed}, '[{''.join(SHAPES)}]') THEN {late} ELSE {composed} END"


class Canonical:
    """The consistent form for the rows of one Python worker."""

    _shared: Canonical | None = None

    def __init__(self) -> None:
        import duckdb

        self.duckdb = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "256MB", "temp_directory": ""})

    @classmethod
    def shared(cls) -> Canonical:
        if cls._shared is None:
            cls._shared = cls()
        return cls._shared

    def over(self, given: pa.Table, select: str):
        """The rows of a SELECT over the table `given`, in which {form} stands for the consistent form of its column t."""
        self.duckdb.register("given", given)
        rare = self.duckdb.sql(f"SELECT DISTINCT unnest(regexp_extract_all(t, '{RARE}')) FROM given WHERE regexp_matches(t, '{RARE}')").fetchall()
        return self.duckdb.sql(select.replace("{form}", canonical_sql("t", [c for (c,) in rare])))

    def __call__(self, texts: pa.Array | list) -> list[str | None]:
        """Null stays null."""
        texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        return [row[0] for row in self.over(pa.table({"t": texts}), "SELECT {form} FROM given").fetchall()]


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes; a single longer row stays whole."""
    for batch in batches:
        rows = max(1, min(len(batch), int(len(batch) * most / max(1, batch.nbytes))))
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def canonical_form(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """Add the consistent form of a string column. Null stays null, empty stays empty.

    Other columns pass through, whatever their names; a column already named `out` is replaced.
    """
    kept = [c for c in df.columns if c != out]
    plain = df.select(*[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(kept)], df[f"`{column}`"].alias("given_text"))
    schema = ", ".join([*(f"k{i} {plain.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(kept))), "form string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Canonical.shared()
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(form(batch.column(len(kept))), pa.string())],
                names=[*(f"k{i}" for i in range(len(kept))), "form"],
            )

    done = spread(plain).mapInArrow(run, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("form").alias(out))


def text_classes(df: DataFrame, item: str, key: str, text: str) -> DataFrame:
    """One row per record with text: item, id, look (hash of the consistent form), exact (hash of the stored text).

    Null and blank texts are left out; repeated rows of one key count once. The hashes have 128 bits and are made
    beside the text, so that whole texts are never shuffled.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Canonical.shared()
        sql = "SELECT id, md5(f) AS look, md5(t) AS exact FROM (SELECT id, t, {form} AS f FROM given) WHERE regexp_matches(f, '[^[:space:]]')"
        for batch in sliced(batches):
            yield from forms.over(pa.Table.from_batches([batch]), sql).to_arrow_table().to_batches()

    done = spread(rows).mapInArrow(run, "id string, look string, exact string")
    return done.dropDuplicates(["id", "look", "exact"]).select(F.lit(item).alias("item"), "id", "look", "exact")


def same_look_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of records of one item kind that look the same but are stored with different characters.

    Classes of a single stored text are dropped by a partial aggregate before any join, so popular exact copies
    never meet each other; then differing stored texts of a class are paired, and only those pairs are expanded to
    their members.
    """
    texts = classes.select("item", "look", "exact").distinct()
    several = texts.groupBy("item", "look").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("item", "look")
    kept = texts.join(several, ["item", "look"], "left_semi")
    a, b = (kept.select("item", "look", F.col("exact").alias(f"exact_{s}")) for s in "ab")
    pairs = a.join(b, ["item", "look"]).where("exact_a < exact_b")
    for s in "ab":
        members = classes.select("item", F.col("look"), F.col("exact").alias(f"exact_{s}"), F.col("id").alias(s))
        pairs = pairs.join(members, ["item", "look", f"exact_{s}"])
    return pairs.where("a <> b").select("item", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
