"""Repetition inside a single document, by weak supervision.

Each rule looks at one kind of repetition (words, word triples, lines, paragraphs, sentences) and votes `repeated` or
`clean`, or abstains. Expectation-maximisation over the counts of vote patterns in all documents estimates each
rule's accuracy; a document's posterior probability of being repetitive follows from its pattern. Patterns are few
(three to the number of rules), so that is all the driver sees of the corpus.

No rule sees the share of repeated words itself, which is the exact check behind the posterior. What ties the two is
that a vote for `clean` is a proof: of the words that lie in repeated runs of 8, at least (9 - g) / 8 begin a
repeated run of g words, so a text with fewer of those cannot have the share. Rules that can prove nothing only vote
`repeated` or abstain. As a rule is held to be right more often than not, a text with that share is never less likely
to be repetitive than one that nothing is known of: its posterior is the prior at least, and the texts below the
prior need no check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import materialize

RUN_WORDS = 8
#: Share of repeated words from which a text is repetitive, unless another one is asked for.
SHARE = 0.3
#: Rules on runs of so many words -> repeated from; they vote `clean` below what the share asked for implies.
GRAM_RULES = {"words": (1, 0.9), "triples": (3, 0.4)}
#: Rules on segments -> (least segments, repeated from), in shares of characters; they prove nothing clean.
SEGMENT_RULES = {"lines": (5, 0.25), "paragraphs": (3, 0.25), "sentences": (3, 0.25)}
RULES = (*GRAM_RULES, *SEGMENT_RULES)
CLEAN, REPEATED, ABSTAIN = 0, 1, 2
#: Letters of text that are measured at a time; a longer text is measured alone.
AT_A_TIME = 1_000_000
#: Characters a line, paragraph or sentence needs to count as one.
LEAST_SEGMENT = 10

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_FINAL_SIGMA, _CAPITAL_SIGMA = 0x3C2, 0x3A3
_tables: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codepoint_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and a number that stands for its lower case."""
    if "letter" not in _tables:
        text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
        letter = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint64)
        for found in regex.finditer(r"\p{L}", text):
            char = found.group()
            letter[ord(char)] = True
            low = char.lower()
            if low != char:
                # a lower case of several characters has no single letter like it
                lower[ord(char)] = ord(low) if len(low) == 1 else 0x110000 + ord(char)
        _tables["letter"], _tables["lower"] = letter, _mix(lower + np.uint64(0x9E3779B97F4A7C15))
    return _tables["letter"], _tables["lower"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the power of 0..n-1 and the inverses, modulo 2^64."""
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"][:n], _tables["down"][:n]


def _again(marks: np.ndarray) -> np.ndarray:
    """Which marks occurred at an earlier place."""
    order = np.argsort(marks, kind="stable")
    same = np.zeros(len(marks), bool)
    same[order[1:]] = marks[order[1:]] == marks[order[:-1]]
    return same


Hashed = tuple[np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def hash_parts(texts: list[str], carried: dict[str, tuple[int, int]] | None = None, ahead: str = "") -> Hashed:
    """The words of the texts (hash, text number), and their lines, paragraphs and sentences (hash, text number, size).

    A hash is of the characters alone, in lower case, wherever they stand. For a text that comes in parts, `texts` is
    the next part and `ahead` the character after it, none for the last one; `carried` holds the sum and the size of
    the line, paragraph and sentence that the parts so far have not ended, and is brought up to date.
    """
    joined = "\n\n".join(texts) + ("" if ahead else "\n\n")
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letter_of, mixed_of = _codepoint_tables()
    letters = letter_of[codes]
    values = mixed_of[codes]
    after = np.r_[letters[1:], False]
    before = np.r_[False, letters[:-1]]
    for at in np.flatnonzero(codes == _CAPITAL_SIGMA):
        if before[at] and not after[at]:
            values[at] = mixed_of[_FINAL_SIGMA]
    doc_ends = np.cumsum(np.array([len(t) + 2 for t in texts], np.int64))
    up, down = _powers(len(codes) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(values * up[:-1])]

    def sums_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * down[start]

    def docs_of(start: np.ndarray) -> np.ndarray:
        return np.searchsorted(doc_ends, start, side="right")

    start, end = np.flatnonzero(letters & ~before), np.flatnonzero(letters & ~after) + 1
    segments = {}
    newline = codes == 10
    following = np.r_[codes[1:], np.uint32(ord(ahead or "\n"))]
    blank = newline & (following == 10)
    stop = np.isin(codes, (46, 33, 63)) & np.isin(following, (32, 10))
    for rule, ends in (("lines", newline), ("paragraphs", blank), ("sentences", stop | blank)):
        cut = np.flatnonzero(ends)
        begin = np.r_[0, cut + 1]
        stretch_ends = np.r_[cut, len(codes)]
        total, size = sums_of(begin, stretch_ends), stretch_ends - begin  # the last one has no end yet
        if carried is not None:
            held, length = carried.get(rule, (0, 0))
            total[:1] = total[:1] * np.uint64(pow(_BASE, length, 2**64)) + np.uint64(held)
            size[0] += length
            carried[rule] = int(total[-1]), int(size[-1])
        begin, total, size = begin[:-1], total[:-1], size[:-1]
        keep = size >= LEAST_SEGMENT
        segments[rule] = _mix(total + size.astype(np.uint64))[keep], docs_of(begin[keep]), size[keep].astype(float)
    return _mix(sums_of(start, end) + (end - start).astype(np.uint64)), docs_of(start), segments


def judge(hashed: Hashed, n_docs: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each rule, and for `runs`, the repeated amount and the whole of every text; of `runs` these are words, exactly."""
    words, doc, segments = hashed
    n_words = np.bincount(doc, minlength=n_docs)

    def salted(marks: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return marks ^ _mix(doc.astype(np.uint64) + np.uint64(1))

    def grams(size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of `size` words within a text, and their hashes."""
        n = len(words) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks = np.zeros(n, np.uint64)
        for k in range(size):
            marks = marks * np.uint64(_BASE) + words[k : k + n]
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        return at, salted(_mix(marks[at]), doc[at])

    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    at, marks = grams(RUN_WORDS)
    at = at[_again(marks)]
    change = np.bincount(at, minlength=len(words) + RUN_WORDS + 1).astype(np.int64)
    change -= np.r_[np.zeros(RUN_WORDS, np.int64), change[:-RUN_WORDS]]
    covered = np.cumsum(change)[: len(words)] > 0
    found["runs"] = np.bincount(doc[covered], minlength=n_docs), n_words
    for rule, (size, _) in GRAM_RULES.items():
        at, marks = grams(size)
        found[rule] = np.bincount(doc[at[_again(marks)]], minlength=n_docs), np.bincount(doc[at], minlength=n_docs)
    for rule, (marks, d, size) in segments.items():
        dup = _again(salted(marks, d))
        total = np.bincount(d, size, minlength=n_docs)
        share = np.divide(np.bincount(d[dup], size[dup], minlength=n_docs), total, out=np.zeros(n_docs), where=total > 0)
        count = np.bincount(d, minlength=n_docs)
        found[rule] = share * count, count
    return found


def cut_long(text: str, most: int) -> Iterator[str]:
    """The text in parts of about `most` characters, cut where no word is: at a paragraph's or a line's end, or else
    before some other character that is no letter."""
    at = 0
    while len(text) - at > most:
        end = at + most
        for mark in ("\n\n", "\n"):
            found = text.rfind(mark, at + 1, end)
            if found > at:
                end = found + len(mark)
                break
        else:
            found = _not_letter.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


_not_letter = regex.compile(r"\P{L}")


def measure(texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """`judge` of some texts, each for itself. A text that is longer than AT_A_TIME is hashed in parts, to keep its
    characters from being held all at once, and judged as a whole; it must be the only one."""
    if len(texts) > 1 or len(texts[0]) <= AT_A_TIME:
        return judge(hash_parts(texts), len(texts))
    parts, carried, at = [], {}, 0
    for part in cut_long(texts[0], AT_A_TIME):
        if part:  # the last one may be empty
            at += len(part)
            parts.append(hash_parts([part], carried, texts[0][at : at + 1]))
    segments = {rule: tuple(np.concatenate(x) for x in zip(*(p[2][rule] for p in parts), strict=True)) for rule in parts[0][2]}
    return judge((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), segments), 1)


def clean_below(share: float, size: int) -> float:
    """The least share of repeated runs of `size` words, over all words, of a text with this share of repeated words.

    The words in repeated runs of 8 are stretches made of such runs; of two that follow each other within 8 words, the
    first adds d <= 8 words to the stretch and at least min(d, 9 - size) places where a repeated run of `size` words begins.
    """
    return share * (RUN_WORDS + 1 - size) / RUN_WORDS


def votes(found: dict[str, tuple[np.ndarray, np.ndarray]], share: float = SHARE) -> np.ndarray:
    """The vote pattern of every text: one digit to the base 3 for each rule, the first rule in the lowest.

    A text with too few words for a run of 8 has no repeated word; the rules on words vote it clean, unless it has none.
    """
    words = found["runs"][1]
    pattern = np.zeros(len(words), np.int64)
    for k, rule in enumerate(RULES):
        part, whole = found[rule]
        if rule in GRAM_RULES:
            size, repeated = GRAM_RULES[rule]
            clean = (part < clean_below(share, size) * words - 1e-9) | (words < RUN_WORDS)
            least = 1
        else:
            least, repeated = SEGMENT_RULES[rule]
            clean = np.zeros(len(words), bool)
        vote = np.where(clean, CLEAN, np.where(part >= repeated * np.maximum(whole, 1), REPEATED, ABSTAIN))
        enough = (whole >= least) if rule in SEGMENT_RULES else (words >= least)
        pattern += np.where(enough, vote, ABSTAIN) * 3**k
    return pattern


def posteriors(patterns: np.ndarray, counts: np.ndarray, steps: int = 500) -> tuple[np.ndarray, float]:
    """Probability of `repeated` for each vote pattern, by expectation-maximisation over the pattern counts, and the
    probability of a text without votes, the prior.

    Rules err independently given the truth; an abstention says nothing. The start is the majority of the votes. A vote
    that is estimated to be more frequent among texts of the other kind is taken to say nothing.
    """
    digits = np.array([[p // 3**k % 3 for k in range(len(RULES))] for p in patterns]).reshape(len(patterns), len(RULES))
    yes, no = digits == REPEATED, digits == CLEAN
    belief = (yes.sum(1) + 0.1) / (yes.sum(1) + no.sum(1) + 1.0)
    weight = counts.astype(float)
    prior = 0.1
    for _ in range(steps):
        prior = float((weight @ belief + 1) / (weight.sum() + 10))
        rates = []
        for share in (belief, 1 - belief):  # of documents of either kind, how often each rule votes for and against
            total = (weight * share).sum() + 2
            rates.append((((weight * share) @ yes + 1) / total, ((weight * share) @ no + 1) / total))
        speaks_for = np.maximum(0, np.log(rates[0][0] / rates[1][0]))
        speaks_against = np.minimum(0, np.log(rates[0][1] / rates[1][1]))
        logit = np.log(prior / (1 - prior)) + yes @ speaks_for + no @ speaks_against
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        moved = np.abs(new - belief).max(initial=0)
        belief = new
        if moved < 1e-10:
            break
    return belief, prior


def _measured(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + AT_A_TIME, side="right")))  # bytes, so no more characters
            part = batch.slice(at, end - at)
            found = measure([t or "" for t in part.column("text").to_pylist()])
            repeated, words = found["runs"]
            columns = [pa.array(x.astype(np.int64)) for x in (words, repeated, votes(found, share))]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "words", "repeated_words", "pattern"])
            at = end


def repetition(df: DataFrame, doc_id: str, text: str, share: float = SHARE) -> DataFrame:
    """(doc_id, words, repeated_words, repeated_share, posterior, possible): repetition within each text.

    A word is a maximal run of letters, in lower case; it is repeated if it lies in a run of 8 consecutive words that
    also begins at an earlier word of the text. The share is repeated words over words, 0 without words. `posterior`
    is the probability that the text is repetitive, of a share of `share` or more; `possible` is whether it is the prior
    at least, which holds for every text of that share. Votes and share are taken in one pass, as reading
    the text is what costs. A null or an empty text has no words; all rules abstain on it.
    One row comes out for every row, repeated rows and null ids included. An empty table gives no rows; further
    columns are ignored.
    """
    schema = T.StructType(
        [T.StructField("id", df.schema[doc_id].dataType)] + [T.StructField(c, T.LongType()) for c in ("words", "repeated_words", "pattern")]
    )
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    measured = materialize(rows.mapInArrow(lambda batches: _measured(batches, share), schema))
    counted = measured.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toArrow()
    patterns, counts = counted["pattern"].to_numpy(), counted["n"].to_numpy()
    belief, prior = posteriors(patterns, counts)
    known = [(int(p), float(b), bool(b >= prior * (1 - 1e-9))) for p, b in zip(patterns, belief, strict=True)]
    lookup = df.sparkSession.createDataFrame(known, "pattern long, posterior double, possible boolean")
    of_all = F.when(F.col("words") > 0, F.col("repeated_words") / F.col("words")).otherwise(0.0)
    return measured.join(F.broadcast(lookup), "pattern").select(  # 3 to the number of rules, at most
        F.col("id").alias(doc_id), "words", "repeated_words", of_all.alias("repeated_share"), "posterior", "possible"
    )


def repetitive(df: DataFrame, doc_id: str, text: str, share: float = SHARE) -> DataFrame:
    """(doc_id): texts whose share of repeated words is at least `share`, above 0. Candidates are the texts whose
    posterior is the prior at least, the share itself is the exact check of them."""
    if not 0 < share <= 1:
        raise ValueError("the share must be above 0 and at most 1")
    found = repetition(df, doc_id, text, share).filter(F.col("possible") & (F.col("repeated_share") >= share))
    return found.select(doc_id).distinct()
