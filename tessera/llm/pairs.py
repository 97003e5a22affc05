"""Defects of prompt and response pairs (problem 1).

Responses sorted by text stand next to their longer versions, so a neighbour's common prefix shows a shortened one;
lengths at which unfinished responses pile up show a length limit. Copy, refusal and language rules follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .canonical import Canonical, sliced
from .langid import MIXED, LanguageModel

# Phrases that decline, words that only frame a refusal, labels before a repeated question.
DECLINING = (
    r"\b(?:i|we)(?:'m| am|'re| are)? (?:afraid )?(?:cannot|can't|can not|could not|couldn't|unable to|not able to|not allowed|not permitted|would rather not|will not|won't|must decline|have to decline|must refuse|decline to|refuse to|prefer not|do not know|don't know|do not have|don't have|have no|found no|find no|found nothing|find nothing)\b",
    # The speaker and a negation in one sentence.
    r"\b(?:i|i'm|i am|me|my)\b.{0,80}\b(?:no|not|nothing|none|never|cannot|\w+n't|unable|declin\w+|refus\w+|unanswered)\b",
    r"\b(?:no|not|nothing|none|never|cannot|\w+n't|unable|unanswered|declin\w+|refus\w+)\b.{0,80}\b(?:i|i'm|me|my)\b",
    r"\b(?:không|chưa|từ chối|khó)\b.{0,80}\b(?:tôi|chúng tôi|em)\b|\b(?:tôi|chúng tôi|em)\b.{0,80}\b(?:không|chưa|từ chối|để trống)\b",
    r"\b(?:je|j'|me|m')(?=\b|\w).{0,80}\b(?:ne|pas|aucun|aucune|rien|refus\w+)\b",
    r"\bnone of the (?:sources|documents|passages|texts|records)\b|\b(?:would|could) (?:only )?be a guess\b|\bchỉ là (?:đoán|phỏng đoán)\b",
    r"\bno (?:answer|information|data|document|passage|source|basis|record)s?\b.{0,60}\b(?:can be|could be|was|were|is|are|mention|mentions|available|exists?|found|given)\b",
    r"\b(?:source|document|passage|text|record|report|material)s?\b.{0,40}\b(?:hold|holds|contain|contains|have|has|give|gives|offer|offers|provide|provides)\b (?:no|nothing)\b",
    r"\b(?:source|document|passage|text|record|material)s?\b.{0,30}\b(?:do|does|did) not (?:mention|contain|say|answer|cover|hold|include)\b",
    r"\bnothing\b.{0,60}\b(?:found|documents?|sources?|mentions?|let me answer|answer)\b",
    r"\bthere (?:is|was|are|were) (?:no|nothing|not enough|too little)\b.{0,60}\bin (?:the|these|those|any|my) (?:\w+ )?(?:sources?|documents?|passages?|texts?|context|materials?|records?)\b",
    r"\b(?:question|this|that|it|which)\b.{0,20}\b(?:cannot|can't|can not|could not|couldn't) be (?:answered|determined)\b|\bno relevant (?:passage|source|document|text|information|data)s?\b",
    r"\b(?:i|we) lack\b|\b(?:is|are) silent (?:on|about)\b|\bbeyond the (?:documents|sources|passages|texts)\b|^\W*(?:cannot|can't|unable to|could not) (?:answer|help|say|determine)\b",
    r"\b(?:insufficient|not enough|too little) (?:information|data|context|evidence)\b.{0,20}\bto (?:answer|respond|say)\b",
    r"\b(?:outside|beyond|not within)(?: of)? (?:what i|the scope|my scope|my remit|my knowledge)\b",
    r"\b(?:tôi|chúng tôi)(?: \w+){0,2}? (?:không thể|không được phép|không có|chưa có|không tìm thấy|chưa tìm thấy|không tìm được|không biết|không rõ|không trả lời|phải từ chối|từ chối|không bàn|không muốn|chưa thể)\b",
    r"\bkhông có (?:căn cứ|cơ sở|thông tin|dữ liệu|tài liệu|câu trả lời)\b",
    r"\b(?:tài liệu|nguồn|văn bản|đoạn trích)\b.{0,30}\bkhông (?:có câu trả lời|nhắc|đề cập|nêu|chứa|trả lời|cho biết)\b",
    r"\b(?:nằm ngoài|ngoài) (?:phạm vi|khả năng)\b",
    r"\bkhông \w+(?: \w+){0,3} nào (?:nhắc|đề cập|nêu|nói|cho biết|trả lời)\b",
    r"\bkhông tìm thấy\b.{0,60}",
    r"\b(?:thông tin|dữ liệu|tài liệu|nguồn)\b.{0,40}\bkhông đủ\b|\bkhông (?:có )?đủ (?:thông tin|dữ liệu|căn cứ|cơ sở)\b|^\W*không thể (?:xác định|trả lời|kết luận)\b",
    r"\bimpossible de (?:répondre|donner une réponse)\b|\bnous ne (?:pouvons|disposons|savons|trouvons)\b|\bdépasse (?:mes|nos) \w+",
    r"\bje (?:ne |n')(?:peux|suis|dispose|trouve|sais|ai)\b",
    r"\b(?:dois|doit) (?:décliner|refuser)\b|\baucune? (?:réponse|information|donnée|source|document)s?\b|\bhors de (?:mon|notre) \w+\b",
    r"\b(?:sources?|documents?|textes?)\b.{0,30}\bne (?:contiennent|contient|donnent|donne|mentionnent|mentionne|permettent|permet)\b",
)
COURTESY = r"\b(?:i|me|my|tôi|chúng tôi|je|you|your|please|thank|thanks|sorry|unfortunately|afraid|else|bạn|quý|vui lòng|xin|hãy|cảm ơn|rất tiếc|vous|votre|merci|désolé|veuillez|malheureusement)\b"
LABELS = r"^(?:[>\-*#\s]|(?:question|q|query|user|prompt|your question|you asked|the question is|answer|a|câu hỏi|hỏi|người dùng|bạn hỏi|câu hỏi của bạn|trả lời|đáp|question posée|réponse)\s*[:：\-])+"
YES_OR_NO = {"yes", "no", "có", "không", "đúng", "sai", "oui", "non"}

_DECLINE = re.compile("|".join(DECLINING))
_COURTESY = re.compile(COURTESY)
_LABEL = re.compile(LABELS)
_ANY_LABEL = re.compile(r"^[^:：\n]{1,40}[:：]")
_MARK = re.compile(r"\s*\[\d+\]")
_CLOSED = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
_ENDS_IN_MARK = re.compile(r"\[\d+\][.!?…]?[\"'”’»)*_]*$")
_OPENING = re.compile(r"(?:^|[.!?\]]\s+|\n\s*(?:[-*] )?)(?:Article|Clause|Section|Chapter|No|Điều|Khoản|Mục|Chương|Art)\.?\s*\d*\.$")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_SHORT = re.compile(r"[\d(+\-$€£₫~≈]\S*(?:\s\S+){0,2}$")
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
#: Characters of a text by which parts of the sorted order are compared.
HEAD = 64
#: The length of a response counts as a limit if this many unfinished ones end there and they are this share of it.
SPIKE, SPIKE_SHARE = 8, 0.8


def is_empty(form: str | None) -> bool:
    """Nothing but marks: no letter or digit apart from references like [1]."""
    return form is None or not any(c.isalnum() for c in _MARK.sub("", form))


def is_copy(question: list[str], answer: list[str]) -> bool:
    """The question's words, once or several times in a row, with at most one more word anywhere."""
    size = len(question)
    if not size or len(answer) < size:
        return False
    times, more = divmod(len(answer), size)
    if more > 1 and not (size == 1 and times > 1):
        return False
    target = question * times
    if not more:
        return answer == target
    i = next((i for i, (a, b) in enumerate(zip(answer, target, strict=False)) if a != b), len(target))
    return answer[:i] + answer[i + 1 :] == target


def is_refusal(form: str) -> bool:
    """At least one sentence declines, and none of the others says anything but courtesy."""
    declines = False
    for sentence in _SENTENCE.split(_MARK.sub("", form)):
        low = sentence.strip().lower()
        if not any(c.isalnum() for c in low):
            continue
        digits = any(c.isdigit() for c in low)
        if _DECLINE.search(low) and not (digits and _contrasts(low)):
            declines = True
        elif digits or not _COURTESY.search(low):
            return False
    return declines


def _contrasts(low: str) -> bool:
    return re.search(r"\b(?:but|although|though|however|elsewhere|nhưng|dù|tuy|song|mais|bien que)\b", low) is not None


def ending(form: str) -> str:
    """closed, short (a complete short answer) or open, from the end of the text."""
    text = form.rstrip()
    if text.count("```") % 2:
        return "open"
    if text.endswith("```") or text.endswith("|") or _ENDS_IN_MARK.search(text):
        return "closed"
    if _OPENING.search(text):
        return "open"
    if _CLOSED.search(text):
        return "closed"
    if text.lower() in YES_OR_NO or _SHORT.match(text):
        return "short"
    return "open"


def judged_pairs(pairs: DataFrame, model: LanguageModel) -> DataFrame:
    """id, form, key (hash of form), chars, end and rule of each (id, question, answer)."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import regex

        words = regex.compile(WORD).findall
        judge, forms = shared.value, Canonical.shared()

        def rule(question: str, form: str | None) -> str | None:
            if is_empty(form):
                return "empty"
            low = form.lower()
            asked = words(question.lower())
            if any(is_copy(asked, words(form_)) for form_ in (low, _LABEL.sub("", low), _ANY_LABEL.sub("", low))):
                return "copy"
            if is_refusal(form):
                return "refusal"
            said, spoken = judge.rows(form), judge.rows(question)
            if len(said) > 2 and len(spoken):
                (a, sure, _), (b, known, _) = judge.judged(said), judge.judged(spoken)
                if a != b and MIXED not in (a, b) and min(sure, known) > 0.9:
                    return "other_language"
            return None

        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            asked, given = forms(batch.column(1)), forms(batch.column(2))
            texts = [(g or "").rstrip() for g in given]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array([hashlib.md5(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([len(t) for t in texts], pa.int32()),
                    pa.array([ending(t) for t in texts], pa.string()),
                    pa.array([rule(q or "", g) for q, g in zip(asked, given, strict=True)], pa.string()),
                ],
                names=["id", "form", "key", "chars", "end", "rule"],
            )

    return pairs.select("id", "question", "answer").mapInArrow(run, "id string, form string, key string, chars int, end string, rule string")


def shortened(texts: DataFrame) -> DataFrame:
    """The keys of texts (key: the md5 of form, form) that a longer text begins with and goes on from, inside a word or
    sentence.

    Equal texts count once, so popular ones can't fill a task; the rest is sorted by range. In sorted order all longer
    versions follow next, so a text stays pending while the following ones begin with it. What is still pending at the
    end of a part, and may go on in the next one, meets all texts in a second pass. Only hashes and the first HEAD
    characters of such texts come to the driver, a few rows a part.
    """
    once = texts.where("form <> ''").groupBy("key").agg(F.first("form").alias("form"))
    ordered = once.repartitionByRange("form").sortWithinPartitions("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, pending = TaskContext.get().partitionId(), None, []
        for batch in batches:
            out = []
            for key, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = form[:HEAD] if start is None else start
                while pending and not form.startswith(pending[-1][1]):
                    pending.pop()
                out += [(k, "shortened", 0, "", "", False, 0) for k, f in pending if goes_on(f, form)]
                pending = [(k, f) for k, f in pending if not goes_on(f, form)] + [(key, form)]
            yield _rows(out)
        if start is not None:
            yield _rows([(k, "pending", len(f), f[:HEAD], start, ending(f) == "closed", part) for k, f in pending])

    def _rows(rows):
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32())
        names = ["key", "what", "chars", "head", "start", "closed", "part"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    seen = written(ordered.select("key", "form").mapInArrow(run, "key string, what string, chars int, head string, start string, closed boolean, part int"))
    cut = seen.where("what = 'shortened'").select("key").distinct()
    ends = seen.where("what = 'pending'").select("key", "chars", "head", "start", "closed", "part").orderBy("part").collect()
    starts = {r.part: r.start for r in ends}
    after = dict(zip(starts, [*starts.values()][1:], strict=False))
    open_ = [(r.chars, r.key, r.head, r.closed) for r in ends if after.get(r.part, "").startswith(r.head)]
    if not open_:
        return cut

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for batch in batches:
            found = set()
            for form in batch.column(0).to_pylist():
                for chars, key, head, closed in open_:
                    if len(form) > chars and (form[chars].isalnum() or not closed) and form.startswith(head) and md5(form[:chars].encode()).hexdigest() == key:
                        found.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    return cut.unionByName(texts.select("form").mapInArrow(meet, "key string")).distinct()


def goes_on(text: str, after: str) -> bool:
    """Whether `after` begins with `text` and goes on where text had no end."""
    if len(after) <= len(text) or not after.startswith(text):
        return False
    return after[len(text)].isalnum() or ending(text) != "closed"


def length_limits(judged: DataFrame) -> DataFrame:
    """Lengths at which unfinished responses pile up: chars."""
    count = judged.where("rule is null or rule = 'other_language'").groupBy("chars").agg(F.sum((F.col("end") != "closed").cast("int")).alias("unfinished"), F.count(F.lit(1)).alias("n"))
    return count.where((F.col("unfinished") >= SPIKE) & (F.col("unfinished") >= SPIKE_SHARE * F.col("n"))).select("chars")


def defects(turns: DataFrame, messages: DataFrame, model: LanguageModel) -> DataFrame:
    """answer_message_id, defect of each turn (answer_message_id, question) whose answer is a message (id, content).

    defect is empty, copy, refusal, truncated, other_language, or null for a usable answer; the first that holds in
    this order. Repeated rows count once; a message with several contents is judged by its greatest, a turn with
    several questions likewise; turns without a message row give none. A null question is no copy and has no language.
    """
    asked = turns.where("answer_message_id is not null").groupBy("answer_message_id").agg(F.max("question").alias("question"))
    given = messages.where("id is not null").groupBy("id").agg(F.max("content").alias("answer"))
    pairs = given.join(asked, given.id == asked.answer_message_id).select("id", "question", "answer")
    judged = written(judged_pairs(pairs, model))
    cut = shortened(judged.select("key", "form")).withColumn("short", F.lit(True))
    limits = length_limits(judged).withColumn("limit", F.lit(True))
    found = judged.join(cut, "key", "left").join(limits, "chars", "left")
    truncated = (F.col("end") == "open") | F.coalesce("short", F.lit(False)) | (F.coalesce("limit", F.lit(False)) & (F.col("end") != "closed"))
    defect = F.when(F.col("rule").isin("empty", "copy", "refusal"), F.col("rule")).when(truncated, F.lit("truncated")).otherwise(F.col("rule"))
    return found.select(F.col("id").alias("answer_message_id"), defect.alias("defect"))
