"""Personal data: base patterns, and contextual patterns that are bootstrapped from what those and credentials given by name find."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, staged
from skeinflow.llm.kernels import LOWER, Words, mix, pieces, span_hashes

U = np.uint64
#: Kinds in their order; "id" is what context alone finds, of no kind in particular, and "secret" what it finds where credentials stand.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
UNKNOWN, SECRET, FAILED = 4, 5, 6
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Credentials as seeds: a value of a dozen characters or more, letters and digits among them, that is given to a name like token or api_key.
GIVEN = re.compile(r"[=:][\x20\x09]{0,4}[\"']?([A-Za-z0-9+/_~-]{12,})")
NAMED = re.compile(r"(?i)(?:key|token|secret|passw(?:or)?d|credential)s?[\"']?[\x20\x09]{0,4}$")
EDGE = "\"'`.,;:!?()[]{}<>|*#$%&"
#: Rounds of scoring; a pattern's least score and least number of different seeds; smoothing of its score.
ROUNDS, LEAST_SCORE, LEAST_SEEDS, SMOOTH = 3, 0.8, 3, 1.0
#: Bits of the filters that tell workers which patterns to look at; others that pass are taken out by an exact join.
FILTER_BITS = 1 << 24
#: A pattern whose seeds are a lesser part of all that stands beside it isn't looked at further: its score is far too low.
LEAST_PART = 0.1
#: Texts whose MD5 is below this, a 64th or so, are counted first.
PART = "04"
#: Words of a slot between two words at most: as many as a base kind has digits. Bytes of a neighbour that a pattern looks at.
SLOT_WORDS, NEIGHBOUR = 19, 40
FOUND = "array<struct<kind:tinyint,start:int,stop:int,instance:bigint,patterns:array<bigint>>>"
#: Patterns of a place, in the order of their array: the word before; the word after; both; the two words before; the word before and the shape.
LEFT, RIGHT, BOTH, TWO, SHAPED = range(5)
TAGS = [U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(5)]

_EDGES = np.zeros(256, bool)
_EDGES[[ord(c) for c in EDGE]] = True
_QUOTES = _EDGES.copy()
_QUOTES[ord(":")] = False
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ",;.:!?"]] = True
#: What a byte adds to a word's shape: a-f, g-z, A-Z, digits, other signs, parts of other characters.
_SHAPES = np.full(256, 16, np.uint8)
_SHAPES[97:103], _SHAPES[103:123], _SHAPES[65:91], _SHAPES[48:58], _SHAPES[128:] = 1, 2, 4, 8, 32
_DIGITS = 8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap: what stands before an @ runs back to the last match at most."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            floor = found.end()
            yield start, floor
        at = text.find("@", max(floor, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) in order of kind, then start; code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """(start, stop) of credentials that are given to a name."""
    out = []
    for m in GIVEN.finditer(text):
        value = m[1]
        if NAMED.search(text, max(0, m.start() - 16), m.start()) and DIGIT.search(value) and not value.isdigit() and any(c.isalpha() for c in value):
            out.append(m.span(1))
    return out


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def failed(text: str, start: int, stop: int) -> bool:
    """Does a base kind's form hold throughout, with its number of digits, although the check doesn't."""
    if IP.fullmatch(text, start, stop):
        return True
    n = sum(c.isdigit() for c in text[start:stop])
    return bool(16 <= n <= 19 and CARD.fullmatch(text, start, stop) or not 8 <= n <= 15 and PHONE.fullmatch(text, start, stop))


def trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """Without signs at the ends; parentheses that close within stay."""
    while start < stop and text[start] in EDGE and not (text[start] == "(" and text.find(")", start, stop) > 0):
        start += 1
    while stop > start and text[stop - 1] in EDGE and not (text[stop - 1] == ")" and text.find("(", start, stop) >= 0):
        stop -= 1
    return start, stop


class Piece:
    """The words of some texts, and what patterns need to know of them, as arrays."""

    def __init__(self, column: pa.Array):
        self.words = w = Words(column, hashed=False)
        self.column, self.data, self.off, self.start, self.stop = column, LOWER[w.data], w.off, w.start, w.end
        self.text = w.text_of()
        lead = (w.data & 0xC0) != 0x80
        #: Code points before each byte; the bytes that code points begin with.
        self.chars = np.concatenate(([0], np.cumsum(lead)))
        self.leads = np.append(np.flatnonzero(lead), len(lead))

    def bytes_of(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte offsets of code points of texts."""
        return self.leads[self.chars[self.off[doc]] + at]

    def chars_of(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.chars[at] - self.chars[self.off[doc]]

    def forms(self, start: np.ndarray, stop: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of spans in lower case without signs at the ends, of their last bytes (left) or first ones; whether anything is left."""
        start, stop = (np.maximum(start, stop - NEIGHBOUR), stop) if left else (start, np.minimum(stop, start + NEIGHBOUR))
        start, stop = stripped(self.data, start, stop)
        return span_hashes(self.data, start, stop), stop > start

    def whole(self) -> tuple[np.ndarray, ...]:
        """(start, stop) of all words without signs at their ends, and their forms as (left, some, right, some); only long words have two."""
        start, stop = stripped(self.data, self.start, self.stop)
        left, some = span_hashes(self.data, start, stop), stop > start
        right, some_right = left, some
        long = np.flatnonzero(self.stop - self.start > NEIGHBOUR)
        if len(long):
            right, some_right = left.copy(), some.copy()
            some = some.copy()
            left[long], some[long] = self.forms(self.start[long], self.stop[long], True)
            right[long], some_right[long] = self.forms(self.start[long], self.stop[long], False)
        return start, stop, left, some, right, some_right

    def shapes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which kinds of characters a span has, and its length (65 for all longer ones)."""
        if not len(start):
            return np.zeros(0, U)
        # Empty spans, at the very end too, count one byte of nothing.
        data = np.concatenate((_SHAPES[self.words.data], np.zeros(2, np.uint8)))
        both = np.stack((start, np.maximum(stop, start + 1)), 1).ravel()
        return np.bitwise_or.reduceat(data, both)[::2].astype(U) | np.minimum(stop - start, 65).astype(U) << U(8)

    def neighbour(self, doc: np.ndarray, at: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Forms of the words at these numbers, where there is such a word in the text."""
        ok = (at >= 0) & (at < len(self.start))
        at = np.where(ok, at, 0)
        if not len(self.start):
            return np.zeros(len(at), U), ok
        h, some = self.forms(self.start[at], self.stop[at], left)
        return h, ok & some & (self.text[at] == doc)

    def around(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(patterns, have) of byte spans, a row of five each: what stands before a span that its word, or an = or : in it, begins, and after one that its word ends."""
        i, j = np.searchsorted(self.start, start, "right") - 1, np.searchsorted(self.start, stop - 1, "right") - 1
        doc, at = self.text[i], start.copy()
        live = np.arange(len(at))
        while len(live):
            live = live[at[live] > self.start[i[live]]]
            live = live[_QUOTES[self.data[at[live] - 1]]]
            at[live] -= 1
        begins = at == self.start[i]
        sign = ~begins & np.isin(self.data[np.maximum(at - 1, 0)], (61, 58))
        one, have_one = self.neighbour(doc, i - 1, True)
        two, have_two = self.neighbour(doc, i - 2, True)
        head, have_head = self.forms(self.start[i], at, True)
        left, have_left = np.where(sign, head, one), np.where(sign, have_head, begins & have_one)
        before, have_before = np.where(sign, one, two), np.where(sign, have_one, begins & have_two)
        at, live = stop.copy(), np.arange(len(stop))
        while len(live):
            live = live[at[live] < self.stop[j[live]]]
            live = live[_EDGES[self.data[at[live]]]]
            at[live] += 1
        right, have_right = self.neighbour(doc, j + 1, False)
        return patterns_of(left, have_left, before, have_before, right, have_right & (at == self.stop[j]), self.shapes(start, stop), i == j)

    def places(self) -> tuple[np.ndarray, ...]:
        """(first byte, byte after, patterns, have, word): every word without signs at its ends, and what follows an = or : in a word."""
        n = len(self.start)
        start, stop, h, some, r, some_r = self.words_whole = self.whole()
        same = np.zeros(n + 2, bool)
        same[1:n] = self.text[1:] == self.text[:-1]
        back = lambda x, k: np.concatenate((np.zeros(k, x.dtype), x[: n - k] if n > k else x[:0]))[:n]
        one, have_one = back(h, 1), back(some, 1) & same[:n]
        two, have_two = back(h, 2), back(some, 2) & same[:n] & back(same[:n], 1)
        right, have_right = np.append(r[1:], np.zeros(1, U))[:n], np.append(some_r[1:], False)[:n] & same[1 : n + 1]
        keep = stop > start
        self.word_shapes = self.shapes(start, stop)
        got = patterns_of(one, have_one, two, have_two, right, have_right, self.word_shapes, np.ones(n, bool))
        whole = [x[keep] for x in (start, stop, *got, np.arange(n))]
        sign = np.flatnonzero((self.data == 61) | (self.data == 58))
        i = np.searchsorted(self.start, sign, "right") - 1
        keep = (i >= 0) & (sign + 1 < self.stop[i]) if n else np.zeros(0, bool)
        sign, i = sign[keep], i[keep]
        head, have_head = self.forms(self.start[i], sign + 1, True)
        start, stop = stripped(self.data, sign + 1, self.stop[i])
        got = patterns_of(head, have_head, one[i], have_one[i], right[i], have_right[i], self.shapes(start, stop), np.ones(len(i), bool))
        keep = stop > start
        return tuple(np.concatenate((a, b[keep])) for a, b in zip(whole, (start, stop, *got, np.full(len(i), -1)), strict=True))


def stripped(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without signs at either end."""
    start, stop = start.copy(), stop.copy()
    live = np.arange(len(start))
    while len(live):
        live = live[start[live] < stop[live]]
        live = live[_EDGES[data[start[live]]]]
        start[live] += 1
    live = np.arange(len(start))
    while len(live):
        live = live[start[live] < stop[live]]
        live = live[_EDGES[data[stop[live] - 1]]]
        stop[live] -= 1
    return start, stop


def patterns_of(left, have_left, before, have_before, right, have_right, shape, have_shape) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five patterns of each place, and which of them it has."""
    pair = lambda tag, a, b: mix(mix(a + TAGS[tag]) + b)
    codes = (mix(left + TAGS[LEFT]), mix(right + TAGS[RIGHT]), pair(BOTH, left, right), pair(TWO, left, before), pair(SHAPED, left, shape))
    have = (have_left, have_right, have_left & have_right, have_left & have_before, have_left & have_shape)
    return np.stack(codes, 1), np.stack(have, 1)


def within(bits: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Which patterns a filter has."""
    k = patterns & U(FILTER_BITS - 1)
    return (bits[k >> U(3)] >> (U(7) - (k & U(7))).astype(np.uint8)) & 1 > 0


def slots(piece: Piece, hot: np.ndarray, sided: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans beside hot patterns: words, runs of words with digits, what stands between the two words of a pair.

    sided has the words before and after of the hot patterns that are pairs.
    """
    start, stop, patterns, have, word = piece.places()
    n = len(piece.start)
    hit = have & within(hot, patterns)
    single = hit[:, BOTH] | hit[:, SHAPED] | (word < 0) & hit.any(1)
    out = [(start[single], stop[single])]
    # Runs: words with digits one after another, up to a sign that ends something.
    digit = piece.word_shapes & U(_DIGITS) > 0
    goes_on = np.zeros(n, bool)
    goes_on[: n - 1] = digit[:-1] & digit[1:] & (piece.text[:-1] == piece.text[1:]) & ~_ENDS[piece.data[piece.stop[:-1] - 1]]
    halts = np.flatnonzero(~goes_on)
    i = word[(word >= 0) & (hit[:, LEFT] | hit[:, TWO])]
    last = halts[np.searchsorted(halts, i)] if len(i) else i
    out.append((piece.start[i], piece.stop[last]))
    i = word[(word >= 0) & hit[:, RIGHT]]
    k = np.searchsorted(halts, i) - 1
    first = np.where(k >= 0, halts[np.maximum(k, 0)] + 1, 0) if len(i) else i
    out.append((piece.start[first], piece.stop[i]))
    # Pairs: from each word that a pair begins with to the nearest that it ends with.
    if n:
        _, _, l, some_l, r, some_r = piece.words_whole
        ends = some_r & within(sided, mix(r + TAGS[RIGHT]))
        live = np.flatnonzero(some_l & within(sided, mix(l + TAGS[LEFT])))
        for gap in range(2, SLOT_WORDS + 2):
            live = live[live + gap < n]
            live = live[piece.text[live + gap] == piece.text[live]]
            at = live[ends[live + gap]]
            at = at[within(hot, mix(mix(l[at] + TAGS[BOTH]) + r[at + gap]))]
            out.append((piece.start[at + 1], piece.stop[at + gap - 1]))
            live = np.setdiff1d(live, at, assume_unique=True)
    spans = np.unique(np.concatenate([np.stack(x, 1) for x in out]), axis=0)
    return spans[:, 0], spans[:, 1]


def seeds_of(piece: Piece) -> list[list[dict]]:
    """Seeds of each text with their patterns: base spans, and credentials that no base span touches."""
    doc, found = [], []
    for d, text in enumerate(piece.column.to_pylist()):
        base = base_spans(text or "")
        for a, b in secrets(text or "") if text else ():
            if not any(x < b and a < y for _, x, y in base):
                base.append((SECRET, a, b))
        doc += [d] * len(base)
        found += [(k, a, b, _hash(KINDS[k], text[a:b].lower())) for k, a, b in base]
    return _with_patterns(piece, doc, found)


def slots_of(piece: Piece, hot: np.ndarray, sided: np.ndarray) -> list[list[dict]]:
    """What stands in the slots of each text's hot patterns and touches no base span, with the patterns that are hot."""
    start, stop = slots(piece, hot, sided)
    doc = np.searchsorted(piece.off, start, "right") - 1
    first, last = piece.chars_of(doc, start).tolist(), piece.chars_of(doc, stop).tolist()
    docs, found, cut = [], [], np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
    for lo, hi in zip(cut, np.append(cut[1:], len(doc)) if len(doc) else [], strict=True):
        text = piece.column[int(doc[lo])].as_py()
        base = np.array([(a, b) for _, a, b in base_spans(text)], np.int64).reshape(-1, 2)
        base, given, seen = base[np.argsort(base[:, 0])], set(secrets(text)), set()
        most = np.maximum.accumulate(base[:, 1]) if len(base) else base[:, 1]
        for a, b in zip(first[lo:hi], last[lo:hi], strict=True):
            k = int(np.searchsorted(base[:, 0], b))
            a, b = trimmed(text, a, b)
            if a >= b or (a, b) in seen or k and most[k - 1] > a:
                continue
            seen.add((a, b))
            kind = SECRET if (a, b) in given else FAILED if failed(text, a, b) else UNKNOWN
            docs.append(int(doc[lo]))
            found.append((kind, a, b, _hash(KINDS[kind] if kind == SECRET else "id", text[a:b].lower())))
    return _with_patterns(piece, docs, found, hot)


def _with_patterns(piece: Piece, doc: list[int], found: list[tuple[int, int, int, int]], hot: np.ndarray | None = None) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(piece.off) - 1)]
    if not found:
        return out
    at = np.array(doc)
    start, stop = (piece.bytes_of(at, np.array([f[k] for f in found])) for k in (1, 2))
    patterns, have = piece.around(start, stop)
    if hot is not None:
        have &= within(hot, patterns)
    for d, (k, a, b, instance), row, has in zip(doc, found, patterns.view(np.int64).tolist(), have.tolist(), strict=True):
        out[d].append({"kind": k, "start": a, "stop": b, "instance": instance, "patterns": [p if h else None for p, h in zip(row, has, strict=True)]})
    return out


def with_places(docs: DataFrame, text: str, name: str, filters: Broadcast | None = None) -> DataFrame:
    """docs without the text, with its seeds; with filters (of hot patterns, and of pairs' sides) what stands in slots."""
    rest = [c for c in docs.columns if c != text]
    item = pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            piece = Piece(batch.column(text))
            got = slots_of(piece, *filters.value) if filters else seeds_of(piece)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(got, pa.list_(item))], [*rest, name])

    return docs.mapInArrow(find, docs.select(*map(quoted, rest)).withColumn(name, F.array().cast(FOUND)).schema)


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score, seeds) from the graph of patterns and instances: edges (pattern, instance, kind).

    An instance is a seed of its kind, or unknown (4), or no identifier (6). A pattern's score for a kind is the belief
    in that kind over its instances, smoothed; for kind 4, belief in any of the kinds. An unknown instance's belief is
    the noisy-or of its patterns' scores of at least a half; a pattern counts it without what it said itself. Rounds
    alternate; all are aggregations by pattern or by instance over distinct edges, with partial sums, so a pattern as
    common as "the" is no group in one task.
    """
    belief, unknown = None, edges.where(f"kind = {UNKNOWN}").select("pattern", "instance")
    doubt = F.log1p(-F.least("score", F.lit(0.999)))
    for _ in range(rounds):
        known = edges.where(f"kind not in ({UNKNOWN}, {FAILED})").select("pattern", "kind", F.lit(1.0).alias("b"), F.lit(1).alias("seed"))
        known = known.union(known.select("pattern", F.lit(UNKNOWN).cast("tinyint"), "b", "seed"))
        if belief is not None:
            others = unknown.join(belief, "instance").join(said, ["pattern", "kind"], "left")
            known = known.union(others.select("pattern", "kind", F.greatest(1 - F.exp(F.col("doubt") - F.coalesce("own", F.lit(0.0))), F.lit(0.0)), F.lit(0)))
        sums = known.groupBy("pattern", "kind").agg(F.sum("b").alias("b"), F.sum("seed").alias("seeds"))
        sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        scores = staged(sums.join(sizes, "pattern").select("pattern", "kind", (F.col("b") / (F.col("n") + SMOOTH)).alias("score"), "seeds"), "patterns")
        strong = scores.where((F.col("score") >= 0.5) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern", "kind", "score")
        said = strong.select("pattern", "kind", doubt.alias("own"))
        belief = staged(unknown.join(strong, "pattern").groupBy("instance", "kind").agg(F.sum(doubt).alias("doubt")), "beliefs")
    return scores


def pattern_filter(patterns: DataFrame) -> np.ndarray:
    """A bit for each remainder of a pattern, FILTER_BITS in all."""
    at = patterns.select(F.expr(f"cast(pmod(pattern, {FILTER_BITS}) as int)").alias("k")).distinct().toArrow().column("k").to_numpy()
    bits = np.zeros(FILTER_BITS, np.uint8)
    bits[at] = 1
    return np.packbits(bits)


def places_beside(docs: DataFrame, text: str, wanted: Broadcast) -> DataFrame:
    """(pattern, n): how often something stands beside each pattern in the filter. A task adds up what it sees before it sends it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known, times = np.zeros(0, U), np.zeros(0, np.int64)

        def settle() -> tuple[np.ndarray, np.ndarray]:
            got, at = np.unique(np.concatenate((known, *held)), return_inverse=True)
            return got, np.bincount(at, np.concatenate((times, np.ones(len(at) - len(times)))), len(got)).astype(np.int64)

        for batch in pieces(batches, text):
            _, _, patterns, have, _ = Piece(batch.column(text)).places()
            patterns = patterns[have]
            held.append(patterns[within(wanted.value, patterns)])
            if sum(map(len, held)) > 1 << 20:
                (known, times), held = settle(), []
            if len(known) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(times)], ["pattern", "n"])
                known, times = known[:0], times[:0]
        known, times = settle()
        if len(known):
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(times)], ["pattern", "n"])

    return docs.select(quoted(text)).mapInArrow(find, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def apart(spans: Column) -> Column:
    """Of spans (weight, kind, start, stop) that overlap the one of most weight; of equal ones the first, of those that begin together the longest."""
    order = F.array_sort(F.transform(spans, lambda p: F.struct((-F.round(p["weight"], 6)).alias("w"), p["start"].alias("a"), (-p["stop"]).alias("b"), p["kind"].alias("k"))))
    plain = F.transform(order, lambda p: F.struct(p["k"].alias("kind"), p["a"].alias("start"), (-p["b"]).alias("stop")))
    none = F.array().cast("array<struct<kind:tinyint,start:int,stop:int>>")
    return F.aggregate(plain, none, lambda out, p: F.when(F.exists(out, lambda q: (q["start"] < p["stop"]) & (p["start"] < q["stop"])), out).otherwise(F.concat(out, F.array(p))))


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with base_spans, spans and unseen_spans: arrays of struct(kind, start, stop), by kind, then start; a taken name gets a _.

    Base spans are exact. The others stand where patterns of high confidence point to, and have the kind that these are
    confident of, or "id". Patterns are induced around seeds: base spans, and credentials that are given to a name. Those
    with several seeds are counted over all texts; of those that seeds are not too small a part of, whatever stands in
    the slots, words or runs of words, with digits or not and of any length, is scored with the seeds as a graph. Seeds
    that are no base spans come out only where a confident pattern points to them; unseen_spans are those of spans that no
    seed pattern matches, which contexts alone have found. Whole texts are searched; null is empty. Rows with equal texts have equal spans; an empty table gives no rows, and one without seeds no spans.
    """
    base, spans, unseen, found, ident, other, new_name = own(docs, "base_spans", "spans", "unseen_spans", "__found", "__id", "__other", "__new")
    docs = docs.withColumn(ident, F.md5(F.coalesce(F.col(quoted(text)), F.lit(""))))
    rows = staged(with_places(docs, text, found), "places")
    texts = docs.select(F.col(ident).alias("id"), F.col(quoted(text)).alias("text"))
    # Equal texts are one text here: copies don't make a pattern surer.
    flat = lambda df, column, key: df.where(F.size(column) > 0).select(F.col(key).alias("id"), F.explode(column).alias("p")).select("id", "p.*").distinct()
    each = staged(flat(rows, found, ident), "seeds")
    linked = lambda df: df.select(F.explode("patterns").alias("pattern"), "instance", "kind").where("pattern is not null").distinct()
    edges = staged(linked(each), "edges")
    context = docs.sparkSession.sparkContext
    first = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS).select("pattern")
    seeds = rows.select(F.explode(found).alias("p")).select(F.explode("p.patterns").alias("pattern")).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("of"))
    hot = staged(first.join(seeds, "pattern"), "first")
    # What a part of the texts shows to be too common is so in all of them: words like "the" are out before the whole is counted.
    for part in (texts.where(F.col("id") < PART), texts):
        counts = places_beside(part, "text", context.broadcast(pattern_filter(hot)))
        hot = hot.join(counts, "pattern", "left").where(F.col("n").isNull() | (F.col("of") >= LEAST_PART * F.col("n")))
        hot = staged(hot.select("pattern", "of"), "hot")
    hot = hot.select("pattern")
    pairs = each.select(F.get("patterns", F.lit(BOTH)).alias("pattern"), F.slice("patterns", 1, 2).alias("of")).where("pattern is not null").distinct()
    sided = pairs.join(hot, "pattern", "left_semi").select(F.explode("of").alias("pattern"))
    filters = context.broadcast((pattern_filter(hot), pattern_filter(sided)))
    beside = staged(flat(with_places(texts, "text", "found", filters), "found", "id"), "slots")
    edges = staged(edges.union(linked(beside)).distinct().join(hot, "pattern", "left_semi"), "edges")
    sure = score_patterns(edges).where((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS))
    # A kind of its own goes before "id".
    order = F.struct(F.col("kind") == UNKNOWN, "kind")
    sure = staged(sure.groupBy("pattern").agg(F.min(order).alias("as"), F.max("score").alias("score")), "sure")
    # A span weighs what its sure patterns score; a seed is believed for itself, too.
    new = beside.where(f"kind in ({UNKNOWN}, {SECRET})").select("id", "start", "stop", (F.col("kind") == SECRET).cast("double").alias("seed"), F.explode("patterns").alias("pattern")).join(sure, "pattern")
    new = new.groupBy("id", "start", "stop").agg(F.min("as").alias("as"), (F.sum("score") + F.max("seed")).alias("weight")).select("id", F.struct("weight", F.col("as.kind").alias("kind"), "start", "stop").alias("p"))
    new = new.groupBy(F.col("id").alias(other)).agg(apart(F.collect_list("p")).alias(new_name))
    out = rows.join(staged(new, "found"), F.col(ident) == F.col(other), "left")
    plain = lambda a: F.transform(a, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["stop"].alias("stop")))
    basic = F.array_sort(plain(F.filter(found, lambda p: p["kind"] < UNKNOWN)))
    added = F.coalesce(new_name, F.slice(basic, 1, 0))
    seed = lambda p: F.exists(found, lambda q: (q["start"] == p["start"]) & (q["stop"] == p["stop"]))
    out = out.withColumns({base: basic, spans: F.array_sort(F.concat(basic, added)), unseen: F.array_sort(F.filter(added, lambda p: ~seed(p)))})
    return out.drop(ident, other, new_name, found)


def as_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(kinds, p["kind"].cast("int")), p["start"].cast("string"), p["stop"].cast("string"))), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null is empty, copies have equal spans. n_found counts what the method adds to the base spans, n_unseen those of them that no seed pattern matches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_personal_data(docs)
    count = lambda k: F.size(F.filter("base_spans", lambda p: p["kind"] == k)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:UNKNOWN])]
    found = (F.size("spans") - F.size("base_spans")).cast("long").alias("n_found")
    return out.select("doc_id", *counts, F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), found, F.size("unseen_spans").cast("long").alias("n_unseen"))


#: What stands around planted identifiers.
BEFORE, AFTER = "kontaktstelle: ", " erreichbar"


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, start, stop): documents with an address, for three ids of five, or an identifier of another form, for one, in one context at their end.

    No seed pattern matches the identifiers: words of letters alone, letters and digits, groups of digits, and an address
    without its sign. start and stop are theirs, null where there is none.
    """
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    number = d.cast("string")
    forms = (
        F.concat(F.lit("anna.b"), number, F.lit("-at-post")),
        F.concat(F.lit("QX"), number),
        F.concat(F.lit("020 "), 1000 + d % 9000, F.lit(" "), 100 + d % 900),
        F.concat(F.lit("nummer-"), F.translate(number, "0123456789", "abcdefghij")),
        F.concat(F.lit("GB"), 10 + d % 90, F.lit(" NWBK "), 1000 + d % 9000),
    )
    other = F.get(F.array(*forms), (F.floor(d / 5) % len(forms)).cast("int"))
    value = F.when(d % 5 < 3, F.concat(F.lit("user"), number, F.lit("@mail"), d % 7, F.lit(".example.org"))).when(d % 5 == 3, other)
    start = F.when(d % 5 == 3, F.length(text) + 1 + len(BEFORE))
    whole = F.when(value.isNull(), text).otherwise(F.concat(text, F.lit("\n" + BEFORE), value, F.lit(AFTER)))
    return docs.select("doc_id", whole.alias("text"), start.alias("start"), (start + F.length(other)).alias("stop"))


def planted_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what planted() adds: whether an unseen identifier is there, is found exactly, and how many others came out that no seed pattern matches."""
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = find_personal_data(docs)
    hit = F.exists("unseen_spans", lambda p: (p["start"] == F.col("start")) & (p["stop"] == F.col("stop")))
    out = out.withColumn("found", F.coalesce(hit, F.lit(False)))
    return out.select("doc_id", F.col("start").isNotNull().alias("planted"), "found", (F.size("unseen_spans") - F.col("found").cast("int")).cast("long").alias("others"))


#: All that is planted is to be found, and nothing else.
PLANTED = "select doc_id, doc_id % 5 = 3 as planted, doc_id % 5 = 3 as found, 0::bigint as others from documents"
