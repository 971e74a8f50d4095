"""Broken prompt and response pairs.

Refusals are found by what recurs: the openings of all responses are clustered
by MinHash (every member is verified against its cluster's representative).
An opening that recurs across prompts that are unlike one another (verified on
their word sets) is a template, and the words and word pairs that a good share
of its members have in common are its vocabulary.  A template is one of refusals
if its members say nothing beyond that vocabulary (those that go on with
content of their own show a mere phrase) and there is evidence for it: rows
flagged for want of context are frequent among them, or most decline in so
many words.  A response that consists of the vocabulary of refusal templates
is a refusal, whatever its own flag and wording.  All shares are relative to the
cluster, so a table ten times as large is judged alike.  Empty, copied,
cut-off and foreign-language responses are labelled by checks on the text and
its prompt.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.words import Codes, mix, words
from heddle.session import cut

# What stands for no answer, compared as words.
PLACEHOLDERS = {
    "n a", "na", "none", "null", "nil", "nan", "undefined", "empty", "no answer", "not available", "no response", "tbd", "todo", "blank", "unknown answer placeholder",
    "sin respuesta", "vacío", "keine antwort", "leer", "aucune réponse", "pas de réponse", "vide", "answer", "response",
}

# Function words by language.
FUNCTION_WORDS = {
    "en": "the a an and of to in is are that this which with for by on not it its they them when while what how does who why at from but if after before once every only between nothing our we",
    "de": "der die das und ist sind nicht ein eine einer dem den des mit für von zu im in auf dass wie was wenn nach ohne bei keine alle wir haben bis weil warum welche wer auch es sobald jede gilt",
    "fr": "le la les et est sont ne pas un une des du de à en que qui pour avec dans sur il elle ce cette parce quand comment pourquoi quelle quelles nous avons sans après toutes chaque aucune lorsque sous",
    "es": "el la los las y es son no un una de del en que por con para se su lo cuando cómo qué quién sin después todas cada ninguna vimos porque si está entre más como guarda quedan",
}
_MEMBERS = {lang: set(text.split()) for lang, text in FUNCTION_WORDS.items()}

# Ways to decline, by language, on lower-case text with plain apostrophes. They are one kind of evidence
# for a template; texts of fewer than ``Checks.least_words`` words need one: "487 kB" recurs like "No puedo".
DECLINES = re.compile(
    r"\b(?:can(?:no|')t|can not|unable|not able|won't|decline|rather not|do(?:n't| not) (?:have|know)|insufficient|not enough|isn't possible|not possible|impossible|no (?:way|means) (?:to|of)"
    r"|nothing i (?:was|have)|lets me answer|sorry|apologi[sz]e|unfortunately"
    r"|(?:kann|darf|könnte|möchte) (?:ich )?|leider|tut mir leid|reicht|nicht (?:genug|möglich|beantworten)|unmöglich|bedaure"
    r"|ne (?:peux|puis|dispose|sais|suis)|impossible|insuffisant|désolé|malheureusement|pas assez|refuse"
    r"|no (?:puedo|me es|tengo|dispongo|es posible|sé)|insuficiente|lo siento|por desgracia|lamento|lamentablemente|imposible)"
)

_TAGS = re.compile(r"<[^<>]*>")
_FENCE = re.compile(r"(?m)^\s*```")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])(?:\s+(.*))?$")
_CLOSED = re.compile(r"[.!?。！？](?:[\"'»”’)\]*_`]*)$")


@dataclass(frozen=True)
class Checks:
    """Parameters.

    ``support``: prompts, none like another (word similarity of ``related`` or
    more), that a template must recur in; ``opening``: words of an opening;
    ``similarity``: of an opening to its cluster's representative;
    ``consensus``: share of a template's members that have a word or pair of
    its vocabulary; ``known_words`` and ``known_pairs``: shares of a refusal's
    words and pairs that are in it; ``closed``: share of a refusal template's
    members that its vocabulary covers so; ``flagged``: least share of flagged
    rows that is evidence; ``least_words``: shorter texts make templates only
    if they decline in so many words.
    """

    support: int = 3
    related: float = 0.8
    opening: int = 10
    bands: int = 4
    rows: int = 2
    similarity: float = 0.5
    consensus: float = 0.2
    known_words: float = 0.85
    known_pairs: float = 0.6
    closed: float = 0.5
    flagged: float = 0.3
    least_words: int = 4
    copied_share: float = 0.8
    tail_words: int = 2


def is_empty(text: str | None) -> bool:
    """Null, blank, or only a placeholder or bare markup."""
    if text is None:
        return True
    found = words(_TAGS.sub(" ", text))
    return not found or " ".join(found) in PLACEHOLDERS


def copies(prompt: list[str], answer: list[str], checks: Checks) -> bool:
    """Whether the answer is the prompt again, once or several times, perhaps slightly changed, and nothing more."""
    if not prompt or not answer:
        return False
    times = max(1, round(len(answer) / len(prompt)))
    asked = Counter(prompt)
    common = sum((Counter({w: n * times for w, n in asked.items()}) & Counter(answer)).values())
    if common < checks.copied_share * len(answer) or common < checks.copied_share * len(prompt) * times:
        return False
    # Words that follow the end of the repeated prompt are an answer.
    tail = 0
    for word in reversed(answer):
        if word in asked:
            break
        tail += 1
    return tail <= checks.tail_words


def is_truncated(text: str) -> bool:
    """Whether the text stops before its sentence, list or code block is complete.

    Complete are a closed sentence, a closed code block, a list whose last
    item is as long as the shortest of the others, and up to three words
    without any mark between them.
    """
    body = text.rstrip()
    if len(_FENCE.findall(body)) % 2:
        return True
    if body.endswith("..."):
        return True
    if _CLOSED.search(body) or body.endswith("```"):
        return False
    if body[-1] in ",;:-–—(/[{…&+=\\<":
        return True
    if body.count("**") % 2:
        return True
    lines = body.split("\n")
    item = _ITEM.match(lines[-1])
    if item:
        others = [len((m.group(1) or "").split()) for m in map(_ITEM.match, lines[:-1]) if m]
        size = len((item.group(1) or "").split())
        return size == 0 or (bool(others) and size < min(others))
    return not (len(lines) == 1 and len(body.split()) <= 3)


def language(tokens: list[str]) -> str | None:
    """The language whose function words prevail clearly, else None."""
    hits = {lang: sum(t in known for t in tokens) for lang, known in _MEMBERS.items()}
    best = max(hits, key=lambda k: hits[k])
    rest = max(v for k, v in hits.items() if k != best)
    return best if hits[best] >= 2 and hits[best] >= 1.5 * rest else None


def _codes(tokens: list[str], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """32-bit codes of the words and of the pairs of neighbours; zero for what holds a digit, which no template shares."""
    found = mix(codes(tokens)).astype(np.uint32)
    found[[any(c.isdigit() for c in t) for t in tokens]] = 0
    pairs = mix(found[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + found[1:]).astype(np.uint32)
    pairs[(found[:-1] == 0) | (found[1:] == 0)] = 0
    return found.view(np.int32), pairs.view(np.int32)


def _covered(texts: DataFrame, vocabulary: DataFrame, checks: Checks) -> DataFrame:
    """(_key, side) of ``texts`` (_key, side, size, units) that consist of the vocabulary (unit); units are words, then pairs."""
    # Up to a million codes (4 MB) go to the texts; more of them meet the units in a shuffle.
    known = F.broadcast(vocabulary) if vocabulary.count() <= 1_000_000 else vocabulary
    units = texts.select("_key", "side", "size", F.posexplode("units").alias("at", "unit")).where("unit <> 0").join(known, "unit")
    words_, pairs_ = F.sum(F.when(F.col("at") < F.col("size"), 1).otherwise(0)), F.sum(F.when(F.col("at") >= F.col("size"), 1).otherwise(0))
    found = units.groupBy("_key", "side", "size").agg(words_.alias("w"), pairs_.alias("p"))
    return found.where((F.col("w") >= checks.known_words * F.col("size")) & (F.col("p") >= checks.known_pairs * (F.col("size") - 1))).select("_key", "side")


def _unrelated(members: DataFrame, checks: Checks) -> DataFrame:
    """(band) of clusters that ``support`` mutually unlike prompts met; ``members``: (band, ask).

    The smallest prompt is taken, then the smallest of those unlike it, and so
    on; one aggregation each, which combines before the shuffle.
    """
    left = members.select("band", "ask").distinct()
    taken = left.groupBy("band").agg(F.min("ask").alias("_taken"))
    for _ in range(checks.support - 1):
        common = F.size(F.array_intersect("ask", "_taken"))
        like = common >= checks.related * (F.size("ask") + F.size("_taken") - common)
        left = left.join(taken, "band").where(~like).select("band", "ask")
        taken = left.groupBy("band").agg(F.min("ask").alias("_taken"))
    return taken.select("band")


def _refusals(checked: DataFrame, checks: Checks) -> DataFrame:
    """(_key, side) of texts that are refusals."""
    # Clusters of openings: the representative of a bucket is its smallest member, every other one is verified against it.
    members = checked.where("bands is not null").select("_key", "side", "opening", "flag", "declines", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min(F.struct("_key", "side", "opening")).getField("opening").alias("_rep"), F.count("*").alias("_n")).where(F.col("_n") >= checks.support)
    common = F.size(F.array_intersect("opening", "_rep"))
    alike = cut(members.join(buckets, "band").where(common >= checks.similarity * (F.size("opening") + F.size("_rep") - common)).select("_key", "side", "band", "flag", "declines"))
    # Evidence: two flagged rows at least, and their share; or the share of declining texts.
    flagged = F.sum(F.when(F.col("flag"), 1).otherwise(0))
    evident = ((flagged >= 2) & (flagged >= checks.flagged * F.count("flag"))) | (F.avg(F.col("declines").cast("double")) > 0.5)
    alike = alike.join(alike.groupBy("band").agg(evident.alias("_evident")).where("_evident").select("band"), "band").select("_key", "side", "band")
    full = alike.join(checked.select("_key", "side", "ask", "size", "units"), ["_key", "side"])
    templates = cut(_unrelated(full.where("ask is not null"), checks))
    within = full.join(templates, "band").select("band", "_key", "side", "size", "units")
    total = within.groupBy("band").agg(F.count("*").alias("_all"))
    units = within.select("band", F.explode(F.array_distinct("units")).alias("unit")).where("unit <> 0").groupBy("band", "unit").agg(F.count("*").alias("_has"))
    shared = cut(units.join(total, "band").where((F.col("_has") >= 2) & (F.col("_has") >= checks.consensus * F.col("_all"))).select("band", "unit"))
    # Templates whose members mostly say nothing of their own.
    texts = within.select("_key", "side", "size", "units").dropDuplicates(["_key", "side"])
    inside = _covered(texts, cut(shared.select("unit").distinct()), checks)
    closed = within.select("band", "_key", "side").join(inside, ["_key", "side"]).groupBy("band").agg(F.count("*").alias("_closed"))
    refusing = closed.join(total, "band").where(F.col("_closed") >= checks.closed * F.col("_all")).select("band")
    vocabulary = cut(shared.join(refusing, "band").select("unit").distinct())
    return _covered(checked.where("bands is not null").select("_key", "side", "size", "units"), vocabulary, checks)


def defects(df: DataFrame, key: str, prompt: str, sides: list[str], flag: tuple[str, str] | None = None, checks: Checks | None = None) -> DataFrame:
    """(key, side, defect) of every defective text; a text has one defect at most.

    ``sides`` are the text columns to check; ``flag`` may name a boolean
    column that tells, not reliably, of a lack of context, and the side it
    speaks of.  A null flag says nothing.  The first defect in this order
    holds: empty, copies_question, refusal, truncated, other_language.  Rows
    with a null key are left out; a null prompt is never copied and has no
    language.  A key seen twice gives its defects once.
    """
    checks = checks or Checks()
    told = lambda s: F.col(flag[0]).cast("boolean") if flag and flag[1] == s else F.lit(None).cast("boolean")
    stacked = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("text"), told(s).alias("flag")) for s in sides])).alias("s")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(prompt).alias("_prompt"), stacked).select("_key", "s.side", "_prompt", "s.text", "s.flag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        salts = mix(np.arange(1, checks.bands * checks.rows + 1, dtype=np.uint64))
        for batch in batches:
            out: list[tuple] = []
            for k, side, ask, text, told_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                question = words(ask)
                if is_empty(text):
                    out.append((k, side, "empty", None, None, None, 0, None, told_, False))
                    continue
                answer = words(text)
                if copies(question, answer, checks):
                    out.append((k, side, "copies_question", None, None, None, 0, None, told_, False))
                    continue
                defect = None
                if is_truncated(text):
                    defect = "truncated"
                else:
                    asked, said = language(question), language(answer)
                    if asked and said and asked != said:
                        defect = "other_language"
                start = opening = units = None
                declines = DECLINES.search(text.lower().replace("’", "'")) is not None
                if len(answer) >= checks.least_words or declines:
                    single, double = _codes(answer, codes)
                    opening = np.unique(double[: checks.opening - 1] if len(double) else single)
                    signature = mix(opening.view(np.uint32).astype(np.uint64)[:, None] ^ salts[None, :]).min(axis=0).reshape(checks.bands, checks.rows)
                    start = mix(signature.sum(axis=1) + np.arange(checks.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
                    units = np.concatenate([single, double])
                topic = np.unique(mix(codes(question)).astype(np.uint32).view(np.int32)) if question else None
                out.append((k, side, defect, topic, start, opening, len(answer), units, told_, declines))
            columns = list(zip(*out, strict=True)) if out else [[]] * 10
            ints = pa.list_(pa.int32())
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), ints, pa.list_(pa.int64()), ints, pa.int32(), ints, pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["_key", "side", "defect", "ask", "bands", "opening", "size", "units", "flag", "declines"])

    kind = df.schema[key].dataType.simpleString()
    checked = cut(rows.mapInArrow(run, f"_key {kind}, side string, defect string, ask array<int>, bands array<long>, opening array<int>, size int, units array<int>, flag boolean, declines boolean"))
    refusals = _refusals(checked, checks).withColumn("_refuses", F.lit(True))
    labelled = checked.select("_key", "side", "defect").join(refusals, ["_key", "side"], "left")
    early = F.col("defect").isin("empty", "copies_question")
    found = F.when(F.col("_refuses") & ~F.coalesce(early, F.lit(False)), F.lit("refusal")).otherwise(F.col("defect"))
    return labelled.select(F.col("_key").alias(key), "side", found.alias("defect")).where("defect is not null").distinct()
