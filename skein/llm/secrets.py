"""Secret scans: fixed patterns, and guess-cost segmentation of values in credential contexts."""

from __future__ import annotations

import hashlib
import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import remove, table, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = re.compile(r"password|passwd|secret|token|apikey|api_key", re.I | re.A)
#: Contexts beyond the fixed ones: a credential's name, a separator or "is", and a value.
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth(?:orization)?|
    (?:api|access|private|secret|auth|signing|encryption)[_\x20-]?(?:key|token|code))
    ["'`]?(?:\x20*(?:[:=]{1,2}|=>|->)\x20*|\x20+(?:is|was|bearer|basic)\x20+|(?<=bearer)\x20+)
    ["'`]?([^\s"'`<>,;()\[\]{}|]{6,})""",
    re.I | re.A | re.X,
)
#: Only texts with one of these can have such a context.
HINT = re.compile(r"pass|pwd|secret|token|credential|bearer|auth|key|code", re.I | re.A)
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Common password words, in order of use; they come before the corpus's own.
WORDS = (
    "password 123456 qwerty dragon master monkey letmein login welcome admin princess sunshine football shadow "
    "superman batman trustno iloveyou secret summer winter spring autumn hello freedom whatever computer internet "
    "user test guest root changeme default example sample token value none null true false string your the and "
    "for this that here insert enter replace todo dummy placeholder redacted hidden unknown server client public "
    "private key pass word code database service account system config env name email phone home work love money"
).split()
#: Guesses (log2) from which a value counts as a secret; the corpus's words that have a rank, and their longest.
LEAST_BITS, MOST_WORDS, LONGEST_WORD = 40.0, 30_000, 24


def ranks_of(words: list[str] = WORDS) -> dict[str, float]:
    """log2 of each word's place in the list, from 1 bit on; of a repeated word the first."""
    return {w: math.log2(i + 2) for i, w in reversed(list(enumerate(words)))}


def corpus_ranks(docs: DataFrame, most: int = MOST_WORDS) -> dict[str, float]:
    """Ranks of the `most` most frequent words of three to LONGEST_WORD letters a-z in docs(text), after WORDS.

    Every word of every text is counted, partly before the shuffle. Only words in the histogram's classes of counts
    that the `most` reach into are ordered, whatever the number of tasks, and the `most` alone come to the driver;
    ties go by the word.
    """
    low = F.explode(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z]+")).alias("w")
    counted = docs.select(low).where(F.length("w").between(3, LONGEST_WORD)).groupBy("w").agg(F.count("*").alias("n"))
    counted = written(counted.where("n > 1"))
    grade = F.floor(F.log2("n") * 16)  # at most 1,024 classes, each of counts within 4.5 %
    held, least = 0, 0
    for r in sorted(counted.groupBy(grade.alias("g")).agg(F.count("*").alias("words")).collect(), reverse=True):
        held, least = held + r["words"], r["g"]
        if held >= most:
            break
    first = written(counted.where(grade >= least).orderBy(F.desc("n"), "w").limit(most))
    found = sorted(first.collect(), key=lambda r: (-r["n"], r["w"]))
    for done in (counted, first):
        remove(done)
    return ranks_of([*WORDS, *(r["w"] for r in found)])


@cache
def _ranks() -> dict[str, float]:
    return ranks_of()


@cache
def _beside() -> set[str]:
    return {r[i : i + 2] for row in ROWS for r in (row, row[::-1]) for i in range(len(r) - 1)}


_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
_LEET = str.maketrans("4@310!5$7", "aaeioisst")


def alphabet(value: str) -> int:
    """How many characters a brute-force span draws from: the classes that occur in the value."""
    n = 0
    if re.search(r"[a-f]", value) or re.search(r"\d", value):
        if re.fullmatch(r"[0-9a-f-]+", value):
            return 16
    for pattern, size in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"\d", 10), (r"[^A-Za-z0-9]", 33)):
        n += size if re.search(pattern, value) else 0
    return max(n, 2)


def guess_bits(value: str, ranks: dict[str, float] | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log2 of the guesses of the cheapest segmentation of `value`, and its spans (start, end, kind).

    cost[e] = min over spans ending at e of cost[start] + the span's own cost + one bit for the
    choice of kind: words by rank (upper case and leet add bits), dates, repeats of one character,
    walks along keyboard rows or through successive characters, and brute force for each character.
    A value of any length is segmented. To part a repeat or a walk costs more than to take it
    whole, so its spans start at its first character or within reach of a word or date that ends in it.
    """
    n = len(value)
    each = math.log2(alphabet(value))
    low = value.lower()
    ranks = _ranks() if ranks is None else ranks
    plain, beside = low.translate(_LEET), _beside()
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    dates: dict[int, list[int]] = {}
    for s in range(n):
        if value[s].isdigit() and (m := _DATE.match(value, s)):
            dates.setdefault(m.end(), []).append(s)
    run = walk = 1
    for e in range(1, n + 1):
        c = value[e - 1]
        found = [(best[e - 1][0] + each, e - 1, "brute")]
        run = run + 1 if e > 1 and c == value[e - 2] else 1
        found += [(best[e - k][0] + 1 + each + math.log2(k), e - k, "repeat") for k in range(max(3, run - LONGEST_WORD), run + 1)]
        step = e > 1 and (low[e - 2 : e] in beside or (c.isalnum() and value[e - 2].isalnum() and abs(ord(c) - ord(value[e - 2])) == 1))
        walk = walk + 1 if step else 1
        found += [(best[e - k][0] + 1 + 6 + math.log2(k), e - k, "walk") for k in range(max(3, walk - LONGEST_WORD), walk + 1)]
        found += [(best[s][0] + 1 + 15, s, "date") for s in dates.get(e, ())]
        for s in range(max(0, e - LONGEST_WORD), e - 2):
            rank = ranks.get(low[s:e])
            if rank is None and (rank := ranks.get(plain[s:e])) is not None:
                rank += 2
            if rank is not None:
                case = 0 if value[s:e] == low[s:e] else 1 if value[s:e] in (low[s:e].upper(), low[s:e].capitalize()) else 4
                found.append((best[s][0] + 1 + rank + case, s, "word"))
        best[e] = min(found)
    spans, e = [], n
    while e:
        _, s, kind = best[e]
        if spans and kind == "brute" == spans[-1][2]:
            spans[-1] = (s, spans[-1][1], kind)
        else:
            spans.append((s, e, kind))
        e = s
    return best[n][0], spans[::-1]


def plain_word(value: str) -> bool:
    """Letters only, perhaps with hyphens or apostrophes, in lower or upper case or capitalised: a word, however rare."""
    parts = re.split("[-']", value)
    return all(x.isalpha() and x in (x.lower(), x.upper(), x.capitalize()) for x in parts)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' matches, leftmost and non-overlapping for each kind, in code points."""
    found = []
    if NAMES.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def guess_spans(text: str, ranks: dict[str, float] | None = None, least_bits: float = LEAST_BITS) -> list[tuple[int, int, str]]:
    """Values in credential contexts whose cheapest segmentation needs 2^least_bits guesses; plain_word()s aren't credentials."""
    if not HINT.search(text):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?")
        if len(value) >= 6 and not plain_word(value) and guess_bits(value, ranks)[0] >= least_bits:
            out.append((m.start(1), m.start(1) + len(value), "guess"))
    return out


def all_spans(text: str, ranks: dict[str, float] | None = None) -> list[tuple[int, int, str]]:
    return sorted([*base_spans(text), *guess_spans(text, ranks)], key=lambda x: (x[0], KINDS.index(x[2])))


def secret_values(text: str, ranks: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Merged spans of the secrets alone, without the names before them."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if NAMES.search(text) else []
    spans += [(s, e) for s, e, k in all_spans(text, ranks) if k != "assign"]
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redacted(text: str, ranks: dict[str, float] | None = None, mark: str = "[secret]") -> str:
    for s, e in reversed(secret_values(text, ranks)):
        text = text[:s] + mark + text[e:]
    return text


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): counts by kind, the digest of the fixed spans, and all spans.

    Guesses are counted with the words of docs by rank (corpus_ranks).

    Null texts count as empty: zero counts, the digest of the empty string, no spans. Texts are
    scanned whole; repeated rows stay as rows; other columns are ignored.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    sent = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs))  # MOST_WORDS words

    def run(batches):
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                t = t or ""
                base, spans = base_spans(t), all_spans(t, sent.value)
                kinds = [x[2] for x in spans]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((d, *map(kinds.count, KINDS), digest, _joined(spans)))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], x) for i, x in enumerate(types)],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in `text` and `n_chars` counted again; null texts stay null.

    Guesses are counted with the words of docs by rank; rows stay as they are otherwise, repeated ones too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs))

    @F.pandas_udf("string")
    def clean(t):
        return t.map(lambda x: redacted(x, sent.value) if isinstance(x, str) else None)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row for each document, by scan() over the whole table."""
    return scan(table(spark, sf_dir, "documents"))
