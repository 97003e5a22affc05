"""Scalar text functions as Columns, so that they stay in the JVM's generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# Markers of a refused answer.
REFUSAL_MARKERS = (
    "không tìm thấy thông tin", "không có thông tin", "không có đủ thông tin", "không đủ thông tin", "không đủ dữ liệu",
    "các nguồn không", "tài liệu không", "ngữ cảnh không", "i could not find", "i don't have enough", "do not contain",
    "does not contain", "insufficient information", "there is no information", "there is no specific", "no information about",
)

# Letters that only Vietnamese has, and common English words.
VIETNAMESE_LETTERS = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
COMMON_ENGLISH = (
    "the a an and or but if of in on at to for from by with about into over after "
    "is are was were be been being do does did done have has had can could will would should may might must "
    "i you he she it we they me him her us them my your his its our their this that these those there here "
    "what which who whom whose when where why how not no yes all any some more most much many few "
    "hello hi hey good morning afternoon evening thanks thank bye goodbye please sorry ok okay cheers welcome"
)
SOCIAL_CORE = "hello hi hey yo greetings morning afternoon evening night thanks thank bye goodbye cheers ok okay okey welcome chào chao cảm cám ơn tạm biệt hẹn"
SOCIAL_PARTICLES = "good you see ya k all thats that everything else nice xin nhé nha ạ à ừ thôi rồi gặp lại"
SOCIAL_ADDRESS = "bạn anh chị em mình thầy cô"
REFERENCE_WORDS = "đó này nầy ấy đấy kia nó họ chúng vậy thế it its that this they them those these he she him her there"
CONTINUATION = r"^\s*(còn|thế còn|vậy còn|còn về|thế thì|vậy thì|what about|how about|and|or)([^\p{L}\p{N}_]|$)"
VIETNAMESE_FUNCTION = (
    "là của có không ở và với cho một các những được bao nhiêu nào gì ai khi đâu sao thì mà nhưng hoặc cũng đã đang sẽ rất quá "
    "hơn nhất về từ đến tới trong ngoài trên dưới cái điều việc con người ta chứ ư nhỉ vẫn còn nữa lại chỉ"
)

_GAP = r"[^\n]{0,120}?"
# Named patterns of instructions hidden in a text, in order.
INJECTION_RULES = {
    "override_instructions": rf"(bỏ qua|phớt lờ|quên (đi|hết)?|không (cần )?(tuân|theo)|đừng (tuân|theo)|ignore|disregard|forget|override){_GAP}(chỉ (dẫn|thị)|hướng dẫn|quy tắc|luật|yêu cầu|instructions?|rules?|prompts?){_GAP}(phía trên|bên trên|ở trên|trước đó|trước đây|previous|prior|above|preceding|earlier)",
    "override_instructions_en": rf"(ignore|disregard|forget|override|bypass){_GAP}(all |any |the )?(previous|prior|above|preceding|earlier|system){_GAP}(instructions?|rules?|prompts?|directions?)",
    "role_reassign": r"(bạn|mày)\s+(giờ|hiện (giờ|nay)|từ (giờ|nay|bây giờ)|bây giờ)\s+(là|sẽ là)|you are (now|from now on)\s+(a |an |the )?(new|different|unrestricted|uncensored|dan\b|developer mode)|từ (giờ|nay|bây giờ)(,)?\s+(bạn|mày)\s+(là|sẽ|hãy)",
    "system_tag": r"<\s*/?\s*system\s*>|\[\s*/?\s*system\s*\]|<\|im_(start|end)\|>|\[/?inst\]|###\s*(system|instruction)|<\|(system|assistant)\|>",
    "protocol_marker": r"citations\s*:\s*\[|<<<\s*(het\s+)?nguon|nguồn nội bộ:\s*\{",
    "structure_forgery": r"(?m)^\s*(ngữ cảnh|câu hỏi|context|question)\s*:\s*$|^\s*\[\d+\]\s*$",
    "prompt_disclosure": rf"(tiết lộ|in ra|hiển thị|nhắc lại|lặp lại|reveal|print|show|repeat|output){_GAP}(prompt hệ thống|chỉ (dẫn|thị) hệ thống|system prompt|your instructions|everything above|toàn bộ (nội dung )?phía trên)",
    "refusal_suppression": rf"(không được|đừng|tuyệt đối không|never|do not|don't){_GAP}(nói|trả lời|từ chối|say|answer|respond|refuse){_GAP}(không đủ (thông tin|dữ liệu)|không biết|không tìm thấy|insufficient|i don't know|cannot answer)",
    "exfiltration": rf"(gửi|thêm vào (cuối|câu trả lời)|đính kèm|chèn (vào|link)|báo về|send|append|post|report .{{0,20}}to|exfiltrate){_GAP}https?://",
    "credential_fish": rf"(api[ _-]?key|mật khẩu|password|token|secret|credential){_GAP}(là gì|cho tôi|in ra|tiết lộ|what is|give me|print|reveal|show)",
}
EMAIL = r"\b[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<![\d.,])(?:\+?84|0)(?:3|5|7|8|9)\d{8}\b"
NATIONAL_ID = r"(?<![\d.,])\d{12}(?![\d.,])"
CARD = r"(?<![\d.,])(?:\d[ -]?){13,19}(?![\d.,])"


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def token_set(text: Column) -> Column:
    """The distinct lower-case words, sorted."""
    return F.array_sort(F.array_distinct(words(F.lower(text))))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with uniform line ends and stripped lines."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    stripped = F.array_join(F.transform(lines, strip), "\n")
    return F.sha2(strip(stripped), 256)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def dedupe_form(text: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))


def slug(text: Column, most: int = 60) -> Column:
    """ASCII letters and digits joined by '-', cut to a length; 'untitled' where nothing is left."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(cut == "", "untitled").otherwise(cut)


def query_key(category: Column, text: Column) -> Column:
    return F.concat_ws("-", category, F.substring(F.sha1(dedupe_form(text)), 1, 10))


def name_uuid(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace (32 hex digits)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    hexed = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    return hexed


def label_digest(ids: Column) -> Column:
    """16 hex digits of the SHA-256 of the sorted distinct ids."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), "\n"), 256), 1, 16)


def sentences(text: Column) -> Column:
    """Pieces after end marks followed by white space, or blank lines."""
    return F.filter(F.split(text, r"(?<=[.!?…])\s+|\n\s*\n"), lambda s: F.trim(s) != "")


def citation_numbers(text: Column) -> Column:
    """Distinct numbers of [n] marks in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda s: s.cast("int")))


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\[\d+\]", ""))


def preview(text: Column, most: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def digit_tokens(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"[0-9][0-9.,%/]*"), F.lit(0)))


def codes(text: Column) -> Column:
    """Distinct identifiers like 24/2019/ND-CP or ABC-123."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z0-9]+(?:[/-][A-Z0-9]+)+"), F.lit(0)))


def looks_refused(text: Column) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for marker in REFUSAL_MARKERS:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def language(text: Column) -> Column:
    """vi, en or unknown, by letters that only Vietnamese has and by common English words."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    latin = F.regexp_count(text, F.lit(r"\p{IsLatin}"))
    english = F.array(*[F.lit(w) for w in COMMON_ENGLISH.split()])
    plain = words(F.regexp_replace(F.lower(text), "['’ʼ]", ""))
    return (
        F.when((letters == 0) | ((letters - latin) * 2 > letters), "unknown")
        .when(F.lower(text).rlike(f"[{VIETNAMESE_LETTERS}]"), "vi")
        .when(F.arrays_overlap(plain, english), "en")
        .otherwise("unknown")
    )


def _list(block: str) -> Column:
    return F.array(*[F.lit(w) for w in block.split()])


def route(text: Column, has_history: Column) -> Column:
    """struct(route, needs_rewrite, reason) of a question: social talk needs no retrieval, a bare reference a rewrite."""
    tokens = F.filter(words(F.regexp_replace(F.lower(text), "['’ʼ]", "")), lambda t: t != "")
    core, social = _list(SOCIAL_CORE), _list(f"{SOCIAL_CORE} {SOCIAL_PARTICLES} {SOCIAL_ADDRESS}")
    stop = _list(f"{COMMON_ENGLISH} {SOCIAL_CORE} {SOCIAL_PARTICLES} {REFERENCE_WORDS} {VIETNAMESE_FUNCTION}")
    is_social = (F.size(tokens) > 0) & (F.size(F.array_except(tokens, social)) == 0) & F.arrays_overlap(tokens, core)
    content = F.size(F.array_except(tokens, stop))
    refers = F.lower(text).rlike(CONTINUATION) | F.arrays_overlap(tokens, _list(REFERENCE_WORDS))

    def out(name: str, rewrite: bool, reason: str) -> Column:
        return F.struct(F.lit(name).alias("route"), F.lit(rewrite).alias("needs_rewrite"), F.lit(reason).alias("reason"))

    return (
        F.when(is_social, out("no_retrieval", False, "social"))
        .when((content == 0) & ~has_history, out("clarify", False, "no_content"))
        .when((content == 0) | (refers & has_history), out("retrieve", True, "reference"))
        .otherwise(out("retrieve", False, "content"))
    )


def injection_flags(text: Column) -> Column:
    """Names of the rules that match the lower-case text with single blanks, in order."""
    flat = F.lower(F.regexp_replace(text, r"[ \t ]+", " "))
    return F.filter(F.array(*[F.when(flat.rlike(rule), F.lit(name)) for name, rule in INJECTION_RULES.items()]), lambda x: x.isNotNull())


# Letters and signs that stand in for plain ones in disguised instructions, and invisible characters.
STAND_INS = ("АВЕІЈКМНОРСТУХаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοɡɛ‘’“”‐‑‒–—", "ABEIJKMHOPCTYXaeopcyxijshdqwABEZHIKMNOPTYXoge''\"\"-----")
UNSEEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def _scan_table() -> tuple[str, str]:
    """Compatibility characters of one plain character by the public Unicode data, and the stand-ins; the unseen go."""
    table = {c: n for c in map(chr, range(0xA0, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c}
    table = {c: n for c, n in table.items() if c not in UNSEEN} | dict(zip(*STAND_INS, strict=True))
    return "".join(table) + UNSEEN, "".join(table.values())


def _mark_table() -> tuple[str, str]:
    """Letters with accents and the letter below them."""
    table = {"đ": "d", "Đ": "D"}
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0].isalpha() and all(map(unicodedata.combining, parts[1:])):
            table[c] = parts[0]
    return "".join(table), "".join(table.values())


SCAN_TABLE, MARK_TABLE = _scan_table(), _mark_table()


def scan_form(text: Column) -> Column:
    """The form in which rules are looked for: plain characters, single blanks and line ends, lower case."""
    plain = F.translate(text, *SCAN_TABLE)
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"[ \t\x0B\f\r]+", " "), r"\n{2,}", "\n"))


def without_marks(text: Column) -> Column:
    """Without accents, whether written in one character or after the letter."""
    return F.regexp_replace(F.translate(text, *MARK_TABLE), r"\p{M}+", "")


def injection_findings(text: Column, seen: Column, plain: Column) -> Column:
    """Names of the rules that match the scan form (seen) or the same without accents (plain), in order, and mixed_script
    for a word of several alphabets in the text as it is. Make both columns first, so that each is made once."""
    rules = [F.when(seen.rlike(rule) | plain.rlike(rule), F.lit(name)) for name, rule in INJECTION_RULES.items()]
    return F.filter(F.array(*rules, F.when(F.size(mixed_script_words(text)) > 0, F.lit("mixed_script"))), lambda x: x.isNotNull())


# Public shapes of credentials, and what stands in their place.
CREDENTIALS = {
    r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=\-]{8,}": r"${1} [secret]",
    r"\b(?:sk|pk|rk)-[A-Za-z0-9_\-]{8,}|\bgh[pousr]_[A-Za-z0-9]{20,}|\bAKIA[0-9A-Z]{16}\b|\bxox[abprs]-[A-Za-z0-9\-]{10,}": "[secret]",
    r"(?i)\b(api[_\-]?key|password|passwd|secret|token)(\s*[=:]\s*)[^\s,;]+": r"${1}${2}[secret]",
}


def without_credentials(text: Column) -> Column:
    """Keys, tokens and passwords replaced."""
    for shape, instead in CREDENTIALS.items():
        text = F.regexp_replace(text, shape, instead.replace("${1}", "$1").replace("${2}", "$2"))
    return text


def mixed_script_words(text: Column) -> Column:
    """Words whose letters come from more than one alphabet."""
    found = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    return F.filter(found, lambda w: w.rlike(r"\p{IsLatin}") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]") | (w.rlike(r"\p{IsCyrillic}") & w.rlike(r"\p{IsGreek}")))


def redacted(text: Column) -> Column:
    """Credentials, then e-mail addresses, phone numbers, card numbers (with a right check digit) and 12-digit ids as
    placeholders."""
    out = F.regexp_replace(F.regexp_replace(without_credentials(text), EMAIL, "[email]"), PHONE, "[sđt]")
    cards = F.filter(F.regexp_extract_all(out, F.lit(CARD), F.lit(0)), lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[ -]", "")))
    out = F.aggregate(cards, out, lambda acc, card: F.replace(acc, F.rtrim(card), F.lit("[thẻ]")))
    return F.regexp_replace(out, NATIONAL_ID, "[cccd]")


def non_blank_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")


def gutter_ratio(text: Column) -> Column:
    """Share of lines with a wide gap between columns."""
    lines = non_blank_lines(text)
    return F.size(F.filter(lines, lambda line: line.rlike(r"\S {3,}\S"))) / F.nullif(F.size(lines), F.lit(0))


def words_per_line(text: Column) -> Column:
    lines = non_blank_lines(text)
    total = F.aggregate(lines, F.lit(0), lambda acc, line: acc + F.regexp_count(line, F.lit(WORD)))
    return total / F.nullif(F.size(lines), F.lit(0))


def looks_like_prose(text: Column) -> Column:
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (
        (F.regexp_count(text, F.lit(WORD)) >= 60) & (letters / F.nullif(visible, F.lit(0)) >= 0.6)
        & (gutter_ratio(text) <= 0.3) & (words_per_line(text) >= 10)
    )


def file_format(path: Column) -> Column:
    """The lower-case suffix with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def quote_found(quote: Column, text: Column, least: int = 12) -> Column:
    """Whether the quote stands in the text, without regard to case and white space; short quotes never do."""
    q, t = (F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")) for c in (quote, text))
    return (F.length(q) >= least) & F.contains(t, q)


def quote_matches(quote: Column, text: Column) -> Column:
    """Whether the parts of a quote between ellipses follow each other in the text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.filter(F.transform(F.split(F.regexp_replace(quote, r"\s+", " "), r"\.\.\.|…"), F.trim), lambda s: s != "")
    end = F.aggregate(
        parts, F.lit(1), lambda at, part: F.when((at > 0) & (F.position(part, flat, at) > 0), F.position(part, flat, at) + F.length(part)).otherwise(F.lit(0))
    )
    return (F.size(parts) > 0) & (end > 0)


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with {{name}} replaced."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def rewritten(question: Column, reply: Column) -> Column:
    """The first line of a rewrite without quotes; null if empty, unchanged or far too long."""
    line = F.trim(F.regexp_replace(F.trim(F.element_at(F.split(F.trim(reply), "\n"), 1)), "^[\"'“”]+|[\"'“”]+$", ""))
    return F.when((line != "") & (line != question) & (F.length(line) <= 4 * F.length(question) + 120), line)
