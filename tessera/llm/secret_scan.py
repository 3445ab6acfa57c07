"""Secret scans: three fixed patterns, and strings that a battery of randomness tests can't tell from random ones.

Patterns (`assign`, `access`, `hex`) are matched leftmost and without overlap, each kind by itself, and short matches
dropped. The battery looks at runs of `[A-Za-z0-9+/_-]` that no match covers, at what matches leave of a run, and at the pieces that these fall into at
`/`, `-`, `_` and `+` in turn, so that a token within a path or behind a name is tested by itself; of strings within each
other that are kept the longest counts. UUIDs are tested by their digits. For each string, the encoding is inferred (the first of ENCODINGS whose alphabet holds it), and the tests ask whether its symbols could be drawn uniformly from that
alphabet: chi-squared tests of uniformity (over classes of symbols, and in the form by equal pairs, which stays sound
for strings shorter than the alphabet), a test of runs above and below the alphabet's middle, and a serial-correlation test of neighbours. The least
p-value, corrected for their number, is the string's. Strings shorter than the encoding's
least length, on which the tests would have too little power, aren't looked at.

False discoveries are held down in two directions. Within a document, strings are called not random at a false-discovery rate, by
Benjamini and Hochberg's procedure with weights in proportion to length (long strings give more evidence than
short ones): that bounds the secrets missed. Over all documents, what is left standing is counted once a distinct string by class of length and by p-value; under
true randomness p-values are uniform, so twice the number above one half estimates how many are random, and the rest of those reported
are words that the tests couldn't reject. Where these are more than the share `wrong` by two standard errors, the class's least p-value is
raised until they aren't (`cuts`): that bounds the reported that aren't secrets. The counts are a bounded table, whatever the corpus.
"""

from __future__ import annotations

import re
from bisect import bisect
from math import erfc, sqrt

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, text_udf

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: The contract's patterns; group 2 of an assignment has 6 characters at least.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LEAST = 20
#: For runs that no alphabet holds: stretches in base64, and words and numbers that stand before or behind a token in them.
STRETCH = re.compile(r"[A-Za-z0-9+/]{20,}")
PLAIN = re.compile(r"[A-Z]?[a-z]*[0-9]{0,2}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Alphabets in order of preference, with the least length that is tested.
ENCODINGS = (
    ("hex", "0123456789abcdef", 20),
    ("HEX", "0123456789ABCDEF", 20),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24),
    ("base32 in small letters", "abcdefghijklmnopqrstuvwxyz234567", 24),
    ("Crockford's base32", "0123456789ABCDEFGHJKMNPQRSTVWXYZ", 24),
    ("Crockford's base32 in small letters", "0123456789abcdefghjkmnpqrstvwxyz", 24),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 20),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 20),
    ("base58", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", 20),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 20),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 20),
)
UUID = re.compile(r"(?<![0-9A-Za-z-])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z-])")
#: A piece beside a match is tested from this length on, together with the match's nearest characters.
BESIDE = 16
#: Classes of length for the counts over all documents, by their largest lengths, and bins of p-values.
LENGTHS, BINS = (24, 32, 48, 64, 128), 50
_places = [(name, {c: k for k, c in enumerate(letters)}, least) for name, letters, least in ENCODINGS]


def encoding(s: str) -> tuple[str, dict[str, int]] | None:
    """Name and places of the first alphabet that holds s, is worth testing and has a least length that s reaches. Digits alone, and letters of one case without a digit, are numbers and words in any of the small alphabets; letters alone are read as base64."""
    digit = any(c.isdigit() for c in s)
    letter = any(c.isalpha() for c in s)
    if not letter:
        return None
    for name, place, least in _places:
        if len(place) < 64 and not digit:
            continue
        if len(s) >= least and all(c in place for c in s):
            return name, place
    return None


def strings(run: str) -> list[tuple[int, int]]:
    """Distinct spans of what is tested in a run: itself, and its pieces at each separator in turn. A run with signs of both
    base64 and base64url also has its stretches in base64, whole and without the words of a path around them, since a token in it may hold `/` and `+`."""
    out = level = {(0, len(run)): None}
    for sign in "/-_+":
        if sign in run:
            cut: dict[tuple[int, int], None] = {}
            for a, b in level:
                for piece in run[a:b].split(sign):
                    if len(piece) >= LEAST:
                        cut[a, a + len(piece)] = None
                    a += len(piece) + 1
            level = cut
            out = out | level
    if ("-" in run or "_" in run) and ("/" in run or "+" in run):
        for m in STRETCH.finditer(run):
            a, b = m.span()
            out[a, b] = None
            while (k := run.find("/", a, b)) >= 0 and PLAIN.fullmatch(run, a, k):
                a = k + 1
            while (k := run.rfind("/", a, b)) >= 0 and PLAIN.fullmatch(run, k + 1, b):
                b = k
            if b - a >= LEAST:
                out[a, b] = None
    return list(out)


def two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def chi_squared(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by Wilson and Hilferty's cube root."""
    return erfc(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) / sqrt(2)) / 2


def classes(s: str, alphabet: dict[str, int]) -> float:
    """Chi-squared test of uniformity over cells large enough for short strings: capitals, small letters, digits and signs, each with its share of the alphabet."""
    cell = lambda c: 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3
    share, seen = [0] * 4, [0] * 4
    for c in alphabet:
        share[cell(c)] += 1
    for c in s:
        seen[cell(c)] += 1
    share[2], seen[2] = share[2] + share[3], seen[2] + seen[3]
    want = [(len(s) * a / len(alphabet), o) for a, o in zip(share[:3], seen[:3], strict=True) if a]
    return chi_squared(sum((o - e) ** 2 / e for e, o in want), len(want) - 1) if len(want) > 1 else 1.0


def tests(s: str, alphabet: dict[str, int]) -> list[float]:
    """p-values of s as uniform draws from the alphabet: classes, equal pairs, runs, neighbours, halves."""
    size, symbols = len(alphabet), [alphabet[c] for c in s]
    n = len(symbols)
    counts: dict[int, int] = {}
    for v in symbols:
        counts[v] = counts.get(v, 0) + 1
    pairs = n * (n - 1) / 2
    equal = sum(c * (c - 1) / 2 for c in counts.values())
    p = [classes(s, alphabet), two_sided((equal - pairs / size) / sqrt(pairs / size * (1 - 1 / size)))]
    high = [2 * v >= size for v in symbols]
    ones = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    # under random draws both the count of runs and the split between halves are as of fair coins
    p.append(two_sided((runs - 1 - (n - 1) / 2) / (sqrt(n - 1) / 2)))
    mid = (size - 1) / 2
    spread = (size * size - 1) / 12
    serial = sum((a - mid) * (b - mid) for a, b in zip(symbols, symbols[1:])) / spread
    p.append(two_sided(serial / sqrt(n - 1)))
    p.append(two_sided((ones - n / 2) / (sqrt(n) / 2)))
    return p


def battery(s: str, alphabet: dict[str, int]) -> float:
    """The p-value of s: the least of the tests' p-values times their number."""
    p = tests(s, alphabet)
    return min(1.0, len(p) * min(p))


def undecided(p: list[float], lengths: list[int], rate: float) -> list[bool]:
    """Which hypotheses the weighted step-up procedure leaves standing at this false-discovery rate. Weights are the lengths over their mean."""
    m = len(p)
    mean = sum(lengths) / m if m else 1
    weighted = [x * mean / n for x, n in zip(p, lengths, strict=True)]
    order = sorted(range(m), key=lambda k: weighted[k])
    last = max((r for r, k in enumerate(order, 1) if weighted[k] <= r * rate / m), default=0)
    out = [True] * m
    for k in order[:last]:
        out[k] = False
    return out


def apart(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest of the spans that overlap, and what is left beside them."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0] - s[1], s)):
        k = bisect(kept, (a, b))
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
            kept.insert(k, (a, b))
    return kept


def outside(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What matches (sorted, apart) leave of a run; short pieces reach into the match beside them, up to LEAST characters."""
    out, at = [], a
    for x, y in [*taken, (b, b)]:
        if x - at >= LEAST:
            out.append((at, x))
        elif x - at >= BESIDE:
            need = LEAST - (x - at)
            if x + need <= b:
                out.append((at, x + need))
            elif at - need >= a:
                out.append((at - need, x))
        at = max(at, y)
    return out


def found_in(text: str | None, rate: float = 0.01) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Base spans (start, end, kind's number), and (start, end, p) of the strings that the document's own control of false discoveries leaves standing."""
    if not text:
        return [], []
    base = []
    low = text.lower()
    if any(w in low for w in WORDS):
        base += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if max(map(len, text.split()), default=0) < LEAST:
        return base, []
    base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    taken: list[tuple[int, int]] = []  # matches of all kinds, those that overlap as one
    for x, y in sorted((a, b) for a, b, _ in base):
        if taken and x < taken[-1][1]:
            taken[-1] = taken[-1][0], max(y, taken[-1][1])
        else:
            taken.append((x, y))
    ends, seen = [y for _, y in taken], {}
    for m in RUN.finditer(text):
        a, b = m.span()
        k = bisect(ends, a)
        near = []
        while k < len(taken) and taken[k][0] < b:
            near.append(taken[k])
            k += 1
        if near and near[0][0] <= a and b <= near[0][1]:
            continue
        for c, d in [(a, b), *outside(a, b, near)] if near else [(a, b)]:
            for x, y in strings(text[c:d]):
                if (c + x, c + y) not in seen and (e := encoding(text[c + x : c + y])):
                    seen[c + x, c + y] = battery(text[c + x : c + y], e[1])
    if "-" in text:
        for m in UUID.finditer(text):
            digits = m[0].replace("-", "").lower()
            seen[m.span()] = battery(digits[:12] + digits[13:16] + digits[17:], _places[0][1])  # without those that name the version
    keep = undecided([*seen.values()], [b - a for a, b in seen], rate)
    return base, [(a, b, p) for ((a, b), p), k in zip(seen.items(), keep, strict=True) if k]


def length_class(n: int) -> int:
    return bisect(LENGTHS, n - 1)


def spans(text: str | None, rate: float = 0.01, cuts: tuple[float, ...] = ()) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) of all spans, by start and then kind; code points, end exclusive. cuts: least p-values by class of length."""
    base, standing = found_in(text, rate)
    kept = [(a, b) for a, b, p in standing if not cuts or p >= cuts[length_class(b - a)]]
    return sorted([*base, *((a, b, 3) for a, b in apart(kept))], key=lambda s: (s[0], s[2], s[1]))


def uniform(p: float) -> float:
    """The battery's p-value as one that is about uniform for random strings: what the least of five independent ones would be."""
    return 1 - (1 - p / 5) ** 5


def raised(counts: list[int], wrong: float) -> float:
    """counts: strings of a class by bins of uniform p-values. The least p-value (of the battery's) at which no more than the share `wrong` of those above it, by two standard errors, are words; 0 if that is so for all of them."""
    random = 2 * sum(counts[BINS // 2 :])
    for k in range(BINS // 2):
        reported = sum(counts[k:])
        words = reported - random * (1 - k / BINS)
        if words - 2 * sqrt(max(1, reported + random)) <= wrong * reported:
            return 5 * (1 - (1 - k / BINS) ** 0.2)
    return 5 * (1 - 0.5**0.2)


def corpus_cuts(docs: DataFrame, text_col: str = "text", rate: float = 0.01, wrong: float = 0.1) -> tuple[float, ...]:
    """Least p-values by class of length, from all texts of docs: a string counts once, however often it occurs. What comes to the driver is a count for each class and bin."""

    def make():
        def work(texts):
            rows = [[(length_class(b - a), min(BINS - 1, int(uniform(p) * BINS)), xxhash.xxh3_64_intdigest(t[a:b]) - (1 << 63)) for a, b, p in found_in(t, rate)[1]] for t in texts]
            return pa.array([[dict(zip(("size", "bin", "mark"), r, strict=True)) for r in own] for own in rows], kind)

        return work

    kind = pa.list_(pa.struct([("size", pa.int32()), ("bin", pa.int32()), ("mark", pa.int64())]))
    each = docs.select(F.explode(text_udf(make, "array<struct<size:int,bin:int,mark:long>>")(F.col(text_col))).alias("s")).select("s.*").distinct()
    counts = [[0] * BINS for _ in range(len(LENGTHS) + 1)]
    for r in each.groupBy("size", "bin").agg(F.count("*").alias("n")).collect():
        counts[r["size"]][r.bin] = r.n
    return tuple(raised(c, wrong) for c in counts)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def spans_udf(rate: float = 0.01, cuts: tuple[float, ...] = ()):
    """A UDF: text to its spans, an array of (kind, start, end). Null and empty texts have none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return text_udf(lambda: lambda texts: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans(t, rate, cuts)] for t in texts], kind), SPANS)


def scan(docs: DataFrame, text_col: str = "text", out: str = "secret_spans", rate: float = 0.01, cuts: tuple[float, ...] = ()) -> DataFrame:
    """docs with the spans of its text added as `out`."""
    return docs.withColumn(out, spans_udf(rate, cuts)(F.col(text_col)))


def redacted(text: str | None, found: list[tuple[int, int]], mark: str) -> str | None:
    """text with each stretch that spans cover (overlapping ones together) replaced by the mark."""
    if not found:
        return text
    parts, at, end = [], 0, -1
    for a, b in sorted(found):
        if a >= end:
            parts += [text[at:a], mark] if end < 0 else [text[end:a], mark]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def redact_udf(rate: float = 0.01, mark: str = "[secret]", cuts: tuple[float, ...] = ()):
    """A UDF: text to the text with its secrets replaced. Null stays null."""
    return text_udf(lambda: lambda texts: pa.array([redacted(t, [(a, b) for a, b, _ in spans(t, rate, cuts)], mark) for t in texts], pa.string()), "string")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random. Texts are read twice: for the counts over all of them, and for the spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, cuts=corpus_cuts(docs)).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("random"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))
