"""Secret scans: fixed patterns, and values in credential contexts that would be hard to guess.

A text is read once, as bytes. Fixed patterns give the base spans. Values that stand where credentials do (after a wider list of
names, in the user part of a URL) and touch no base span are judged by the cost of guessing them: the cheapest way to cut a value into
dictionary words, dates, repeats, keyboard walks and single characters that must be tried out, found by dynamic programming over
its positions. Values at or over the least cost are added to the spans.

The dictionary is the corpus itself: each task counts the words of its texts outside the values, and partial counts are summed
by a shuffle. A word's cost is how many words of the corpus there are to one of it. Only the words within values are
joined to these counts; values, few beside the texts, meet their words and their costs by joins whose frequent keys are spread
over SALTS parts.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import staged, task_row_ids

# The base patterns, which match ASCII letters only, and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "guess")

CONTEXTS = (
    re.compile(rb"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|session|secret)[_-]?key|credentials?|auth(?:orization)?)[\"']?[ \t]{0,8}(?:[:=]>?|[ \t]is[ \t])[ \t]{0,8}(?:(?:bearer|basic)[ \t]+)?(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;<>()\[\]{}]{6,}))", re.IGNORECASE),
    re.compile(rb"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/@]{6,})@", re.IGNORECASE),
)
CONTEXT_SIGNS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"://")

LEAST_COST = 10.0  # log10 of guesses
PIECE = 128  # a longer value is judged in pieces of so many code points and is as strong as its strongest piece
TRIED, JOINT, VARIANT = 1.0, 0.3, 0.3  # log10 cost of a character tried out, of another span, of capitals or letter-like signs
SHORTEST, LONGEST, LEAST_COUNT = 3, 20, 5  # of dictionary words: code points, occurrences
HELD_WORDS = 300_000  # distinct words that a task counts before it sends them
SLICE = 4_000_000
SALTS = 32
_LOWER = {c: c + 32 for c in range(65, 91)}
_LETTERS = _LOWER | str.maketrans("@483015$7!", "aabeoisstl")  # signs that stand for letters
_WORDS = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 48 if chr(b).isdigit() or b == 95 else 32 for b in range(128)) + bytes(range(128, 256))
_ROWS = "`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./"
_FIRST_YEAR, _LAST_YEAR = 1900, 2050
_DATE = re.compile(r"(\d{1,2})([-/._ ]?)(\d{1,2})\2(\d{4}|\d{2})|(\d{4})([-/._ ]?)(\d{1,2})\6(\d{1,2})", re.ASCII)
_REPEAT = re.compile(r"(.{1,32}?)\1+", re.DOTALL)
_SPAN = "struct<start:long,kind:int,end:long>"
_READ = f"row long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<{_SPAN}>, found array<struct<start:long,end:long,pieces:array<string>>>, word string, n long"


def _neighbours() -> dict[str, str]:
    """Keys beside each key: in its row, and in the rows above and below at the same place and half a key on."""
    at = {c: (r, x) for r, row in enumerate(_ROWS) for x, c in enumerate(row) if c != " "}
    near = lambda p, q: p[0] == q[0] and abs(p[1] - q[1]) == 1 or p[0] - q[0] == 1 and q[1] - p[1] in (0, 1) or q[0] - p[0] == 1 and p[1] - q[1] in (0, 1)
    return {c: "".join(d for d in at if near(at[c], at[d])) for c in at}


NEIGHBOURS = _neighbours()
_KEYS, _DEGREE = len(NEIGHBOURS), sum(map(len, NEIGHBOURS.values())) / len(NEIGHBOURS)


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in a text, as places in its bytes, in order."""
    low = raw.lower()
    out = []
    if any(x in low for x in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    flags = raw.translate(_IS_HEX)  # runs that are long enough are looked for first
    at = flags.find(_HEX_RUN)
    while at >= 0:
        m = HEX.match(raw, at)
        out.append((at, 2, m.end()))
        at = flags.find(_HEX_RUN, m.end())
    return sorted(out)


_IS_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_HEX_RUN = b"1" * LEAST_HEX


def context_values(raw: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of values in credential contexts that touch no taken span and not each other, as places in the bytes."""
    low = raw.lower()
    if not any(x in low for x in CONTEXT_SIGNS):
        return []
    found = []
    for pattern in CONTEXTS:
        for m in pattern.finditer(raw):
            start, end = m.span(m.lastindex)
            if m.lastindex in (None, 3):  # no quotes: a sentence's signs are not of the value
                end = start + len(raw[start:end].rstrip(b".,:;!?"))
            found.append((start, end))
    out, busy, k = [], [(s, e) for s, _, e in taken], 0
    for start, end in sorted(found):
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        free = k == len(busy) or busy[k][0] >= end
        if free and end - start >= LEAST_ASSIGN and (not out or out[-1][1] <= start):
            out.append((start, end))
    return out


def count_words(raw: bytes, without: list[tuple[int, int]], into: Counter) -> None:
    """Words of letters only, in lower case, outside the spans of without."""
    at = 0
    for start, end in [*sorted(without), (len(raw), len(raw))]:
        while at < start:
            stop = min(start, at + SLICE)
            stop = stop if stop == start else (raw.find(b" ", stop, start) + 1 or start)
            into.update(raw[at:stop].translate(_WORDS).split())
            at = stop
        at = max(at, end)


def words_of(value: str) -> set[str]:
    """All stretches of a value's letters, or of signs read as letters, that a dictionary word could be."""
    out = set()
    for text in (value.translate(_LOWER), value.translate(_LETTERS)):
        for run in re.findall(r"[a-z\x80-\U0010ffff]{3,}", text):
            out.update(run[i:j] for i in range(len(run)) for j in range(i + SHORTEST, min(len(run), i + LONGEST) + 1))
    return out


def _is_date(day: str, month: str, year: str) -> bool:
    full = int(year) if len(year) == 4 else 2000 + int(year)
    if not _FIRST_YEAR <= full <= _LAST_YEAR:
        return False
    for d, m in ((int(day), int(month)), (int(month), int(day))):
        try:
            return bool(datetime.date(full, m, d))
        except ValueError:
            pass
    return False


def known_spans(value: str, counts: dict[str, int], total: int) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of every word, date, year, repeat and keyboard walk in a value."""
    low, years = value.translate(_LOWER), _LAST_YEAR - _FIRST_YEAR + 1
    for text in (low, value.translate(_LETTERS)):
        for i in range(len(text)):
            for j in range(i + SHORTEST, min(len(text), i + LONGEST) + 1):
                if (n := counts.get(text[i:j])) is not None:
                    yield i, j, math.log10(max(total / n, 1)) + (VARIANT if text[i:j] != value[i:j] else 0)
    for i in range(len(value)):
        if (y := value[i : i + 4]).isascii() and y.isdigit() and len(y) == 4 and _FIRST_YEAR <= int(y) <= _LAST_YEAR:
            yield i, i + 4, math.log10(years)
        for end in (10, 8, 6):
            if (m := _DATE.fullmatch(value, i, min(i + end, len(value)))) and _is_date(*((m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5]))):
                yield i, m.end(), math.log10(366 * years) + (VARIANT if m[2] or m[6] else 0)
        if (m := _REPEAT.match(value, i)) and m.end() - i >= 3:
            yield i, m.end(), guess_cost(m[1], counts, total) + math.log10((m.end() - i) // len(m[1]))
        j, turns, way = i + 1, 1, None
        while j < len(low) and (low[j] in NEIGHBOURS.get(low[j - 1], "") or ord(low[j]) - ord(low[j - 1]) in (1, -1) and low[j - 1 : j + 1].isalnum()):
            step = ord(low[j]) - ord(low[j - 1]) if low[j] not in NEIGHBOURS.get(low[j - 1], "") else NEIGHBOURS[low[j - 1]].index(low[j]) * 1000
            turns += way is not None and step != way
            way, j = step, j + 1
            if j - i >= 4:
                yield i, j, math.log10(_KEYS * (j - i)) + turns * math.log10(_DEGREE)


def guess_cost(value: str, counts: dict[str, int], total: int) -> float:
    """log10 of the guesses that the cheapest segmentation of a value takes."""
    ends: dict[int, list[tuple[int, float]]] = {}
    if len(value) > 2:
        for i, j, cost in known_spans(value, counts, total):
            ends.setdefault(j, []).append((i, cost))
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min([best[j - 1] + TRIED, *(best[i] + cost + JOINT for i, cost in ends.get(j, ()))]))
    return best[-1]


def _read(batches: Iterator[pa.RecordBatch]):
    ids, words = task_row_ids(), Counter()
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()),
                        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
                        ("found", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pieces", pa.list_(pa.string()))]))), ("word", pa.string()), ("n", pa.int64())])

    def counted():
        own = [(w, n) for w, n in words.items() if SHORTEST <= len(w) <= 4 * LONGEST and b"0" not in w]
        words.clear()
        columns = [pa.array([w for w, _ in own], pa.binary()).cast(pa.string()), pa.array([n for _, n in own], pa.int64())]
        return pa.RecordBatch.from_arrays([pa.nulls(len(own), f.type) for f in schema][:-2] + columns, schema=schema)

    for b in batches:
        rows = []
        for doc, raw in zip(b.column(0).to_pylist(), b.column(1)):
            raw = raw.as_py()
            base = base_spans(raw)
            values = context_values(raw, base)
            count_words(raw, [(s, e) for s, _, e in base] + values, words)
            place, done, points = {}, 0, 0  # bytes to code points, on the way through the text
            for x in sorted({x for s, _, e in base for x in (s, e)} | {x for v in values for x in v}):
                points += len(raw[done:x].decode())
                place[x], done = points, x
            spans = [{"start": place[s], "kind": k, "end": place[e]} for s, k, e in base]
            text = ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in spans)
            found = [{"start": place[s], "end": place[e], "pieces": [v[p : p + PIECE] for p in range(0, len(v), PIECE)]} for s, e in values for v in [raw[s:e].decode()]]
            n = Counter(k for _, k, _ in base)
            rows.append({"row": next(ids), "doc_id": doc, "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(text.encode()).hexdigest(), "base": spans, "found": found})
            if len(words) > HELD_WORDS:
                yield counted()
        yield pa.RecordBatch.from_pylist(rows, schema)
    yield counted()


def _pieces_words(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for piece in b.column(0).to_pylist():
            own = sorted(words_of(piece))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([piece] * len(own)), pa.array(own)], names=["piece", "word"])


def _costs(total: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            pieces = b.column(0).to_pylist()
            cost = [guess_cost(p, {w["word"]: w["n"] for w in own or ()}, total) for p, own in zip(pieces, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cost, pa.float64())], names=["piece", "cost"])

    return run


def _spread(right: DataFrame) -> DataFrame:
    return right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def piece_costs(pieces: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(piece, cost) of distinct pieces; words: (word, n) of the corpus, total: the sum of all n."""
    asked = pieces.mapInArrow(_pieces_words, "piece string, word string")
    known = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    known = known.join(asked.select("word").distinct(), "word", "left_semi")
    hits = asked.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(SALTS))).join(_spread(known), ["word", "salt"])
    own = hits.groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("words"))  # bounded by PIECE
    return pieces.join(own, "piece", "left").select("piece", "words").mapInArrow(_costs(total), "piece string, cost double")


def scan_secrets(docs: DataFrame, least_cost: float = LEAST_COST) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) of each row of docs.

    Spans are kind:start:end in code points, by start, then kind; ``guess`` spans are values in credential contexts whose
    guesses have a log10 of least_cost or more. Null and empty texts have no spans (the hash of no text); repeated rows and
    null ids have a row each; empty tables give no rows; other columns don't matter. A text is never cut; a value of more than
    PIECE code points is judged in pieces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    read = staged(rows.mapInArrow(_read, _READ), "secrets")
    words, texts = read.where("word is not null").select("word", "n"), read.where("word is null").drop("word", "n")
    total = words.agg(F.sum("n")).first()[0] or 1
    found = texts.select("row", F.explode("found").alias("x")).select("row", "x.start", "x.end", F.explode("x.pieces").alias("piece"))
    pieces = staged(found.select("piece").distinct(), "pieces")
    strong = piece_costs(pieces, words, total).where(F.col("cost") >= least_cost).select("piece")
    hard = found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(_spread(strong), ["piece", "salt"])
    added = hard.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("added"))
    added = texts.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("base", "added")), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    return added.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"), F.size("added").cast("long").alias("n_guess"))
