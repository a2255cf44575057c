"""Problem 8: documents that hold passages of held-out evaluation items.

Windows of item size are embedded by CGK random walks: a token is emitted at
every step and the walk moves on or stays by a random bit of (step, token), so
that windows within a small edit distance become sequences within a small Hamming
distance. Each repetition samples some steps of its own walk as a hash key.
Items give keys at every offset; documents are probed at a stride that puts a
whole window inside every stretch that counts. Items of bounded size travel as an
index and documents are scanned in place; more items than that meet the documents
in a join on the keys, hot keys salted. Candidates are verified exactly either
way: item and document are aligned within a band around the hit, and runs that
only single changed, added or dropped words part are joined.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import HAN, bounded
from colloquy.session import durable, small

#: Least stretch: words, or characters where the item is in Han script.
LEAST_WORDS, LEAST_CHARS = 25, 35
#: Tokens in a window, stride over documents (window + stride - 1 <= least stretch), steps of the walk.
WINDOW = {False: (17, 9), True: (22, 12)}
STEPS, REPS, SAMPLED = 30, 12, 5
#: Characters of items that travel as one broadcast index (some 50 MB); more are joined on their keys.
BLOCK = 1_500_000
#: Rows from which a key is hot in that join, most hot keys, and parts that the rows of one are spread over.
HOT, MOST_HOT, SALTS = 10_000, 10_000, 32

_LINE = re.compile(
    r"(?m)^[ \t]*(?:[-*•·–#>]+[ \t]+|\d{1,2}[.)][ \t]+)?(?:[\[(<〔【]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?:[ \t]*-->[ \t]*[\d:.,]+)?[\])>〕】]?[ \t]*)?"
    r"(?:(?:s\d{1,3}|[a-z][\w.'-]*(?: [a-z\d][\w.'-]*){0,2}|[一-鿿]{2,8})[:：][ \t]*)?(?:[-*•·–]+[ \t]+)?"
)
_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+(?:[.,'’][^\W_一-鿿]+)*")


#: A token is one of these or holds none.
_HAN_CHARS = frozenset(map(chr, range(ord("一"), ord("鿿") + 1)))


def tokenise(text: str) -> list[str]:
    """Words, and single Han characters, of a lower-cased text without labels, bullets and time stamps of its lines."""
    return _TOKEN.findall(_LINE.sub(" ", text.lower()))


def han_tokens(words: list[str]) -> np.ndarray:
    """Whether each token is a Han character."""
    return np.fromiter(map(_HAN_CHARS.__contains__, words), dtype=bool, count=len(words))


class Vocabulary:
    """Stable 64-bit codes of tokens, the same in every process."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > 2_000_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w.encode()) | zlib.adler32(w.encode()) << 32
            return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(30)
    return x


def sampled_steps(rep: int) -> list[int]:
    """The steps that a repetition samples: one in each of SAMPLED equal parts of the walk."""
    rng = np.random.default_rng(1_000 + rep)
    edges = np.linspace(0, STEPS, SAMPLED + 1).astype(int)
    return [int(rng.integers(a, b)) for a, b in zip(edges, edges[1:])]


def embed(codes: np.ndarray, starts: np.ndarray, window: int, rep: int) -> np.ndarray:
    """Hash key of each window in one repetition: the sampled steps of its CGK walk. codes: all tokens; starts: of the windows."""
    bits = mixed(codes, 2 * rep + 1)
    take = set(sampled_steps(rep))
    at, end = starts.astype(np.int64), starts.astype(np.int64) + window - 1
    key = np.full(len(starts), rep + 1, dtype=np.uint64)
    for step in range(max(take) + 1):
        if step in take:
            key = key * np.uint64(0x100000001B3) + mixed(codes[at], 2 * rep + 2)
        at += (bits[at] >> np.uint64(step)).astype(np.int64) & 1
        np.minimum(at, end, out=at)
    return key


#: What a candidate window may lose of its full score in alike(): 1 for a changed token, 2 for one dropped, 1 for one added.
LOST = {False: 5, True: 8}


def alike(doc: np.ndarray, a: np.ndarray, item: np.ndarray, z: np.ndarray, window: int) -> np.ndarray:
    """Of each pair of windows, of doc from a and of item from z, the most tokens equal along a path whose shift, between -2 and 2, may change by 1 from token to token at a cost of 1."""
    ahead = np.minimum(a[:, None] + np.arange(-2, window + 2), len(doc) - 1)
    near = doc[np.maximum(ahead, 0)].T
    best = np.zeros((5, len(a)), dtype=np.int8)
    for j in range(window):
        w = item[np.minimum(z + j, len(item) - 1)]
        moved = best.copy()
        moved[1:] = np.maximum(moved[1:], best[:-1] - 1)
        moved[:-1] = np.maximum(moved[:-1], best[1:] - 1)
        best = moved + (near[j : j + 5] == w)
    return best.max(axis=0)


class Index:
    """Of one block of items and one script: window keys of every offset, sorted per repetition."""

    def __init__(self, items: list[tuple[int, list[str]]], han: bool):
        self.han = han
        self.window, self.stride = WINDOW[han]
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.weights = [weights_of(w, han) for w in self.words]
        vocabulary = Vocabulary()
        parts, starts, owner, offset, base = [], [], [], [], 0
        for n, words in enumerate(self.words):
            count = max(0, len(words) - self.window + 1)
            parts.append(vocabulary.codes(words))
            starts.append(np.arange(base, base + count))
            owner.append(np.full(count, n, dtype=np.int32))
            offset.append(np.arange(count, dtype=np.int32))
            base += len(words)
        # Tokens of its own script that a document's window with a shift of two on both sides holds at least where candidates() may keep it: four, or six and four for shifts, less than any window here.
        own = np.concatenate([[0], *(han_tokens(w) == han for w in self.words)]).cumsum()
        here = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
        self.least = int((own[here + self.window] - own[here]).min(initial=self.window)) - (10 if han else 4)
        self.ends = np.cumsum([len(w) for w in self.words])
        self.codes = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        self.starts = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, dtype=np.int32)
        self.offset = np.concatenate(offset) if offset else np.empty(0, dtype=np.int32)
        self.keys = []
        for rep in range(REPS):
            k = embed(self.codes, self.starts, self.window, rep) if len(self.starts) else np.empty(0, dtype=np.uint64)
            order = np.argsort(k, kind="stable")
            self.keys.append((k[order], order))
        # A Bloom-like table of 2^20 bits per repetition answers almost all probes without a search.
        self.seen = []
        for k, _ in self.keys:
            table = np.zeros(1 << 20, dtype=bool)
            table[mixed(k, 99) >> np.uint64(44)] = True
            self.seen.append(table)

    def item_codes(self, n: int) -> np.ndarray:
        return self.codes[self.ends[n] - len(self.words[n]) : self.ends[n]]

    def possible(self, script: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Those of the starts whose windows hold enough tokens of this index's script. script: whether each token is a Han character."""
        if self.least <= 0:
            return starts
        own = np.concatenate([[0], script == self.han]).cumsum()
        return starts[own[np.minimum(starts + self.window + 2, len(script))] - own[np.maximum(starts - 2, 0)] >= self.least]

    def candidates(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among starts, place among own windows) of all collisions whose windows agree in about half of their tokens, each half at a shift of its own."""
        found = []
        if not len(self.starts) or not len(starts):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for rep in range(REPS):
            key = embed(codes, starts, self.window, rep)
            may = np.flatnonzero(self.seen[rep][mixed(key, 99) >> np.uint64(44)])
            keys, order = self.keys[rep]
            low, high = np.searchsorted(keys, key[may], "left"), np.searchsorted(keys, key[may], "right")
            n = high - low
            hit = n > 0
            may, low, n = may[hit], low[hit], n[hit]
            if len(may):
                own = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                found.append(np.repeat(may, n).astype(np.int64) * len(self.starts) + own)
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        pair = np.unique(np.concatenate(found))
        place, own = pair // len(self.starts), pair % len(self.starts)
        a, z = starts[place], self.starts[own]
        keep = alike(codes, a, self.codes, z, self.window) >= self.window - LOST[self.han]
        return place[keep], own[keep]


#: Least stretch; unchanged tokens that must stand between two changed words; share of a stretch that may be changed.
LEAST, BETWEEN, SHARE = {False: LEAST_WORDS, True: LEAST_CHARS}, {False: 3, True: 4}, {False: 0.12, True: 0.13}
#: Tokens that one changed word may have (characters in Han text), how many more it may have on one side than on the other, and shifts of the band.
GAP, STEP, BAND = {False: 1, True: 5}, {False: 1, True: 2}, {False: 4, True: 8}


def stretch(same: np.ndarray) -> tuple[int, int]:
    """(start, end) of the longest run of equal tokens in which only single tokens differ, BETWEEN equal ones apart and in all no more than SHARE. same: equal or not, by place."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    runs = edges.reshape(-1, 2).tolist()
    best = (0, 0)
    for i, (first, z) in enumerate(runs):
        changed, last = 0, z
        if z - first > best[1] - best[0]:
            best = first, z
        for j in range(i + 1, len(runs)):
            a, z = runs[j]
            if a - last > 1 or j - 1 > i and last - runs[j - 1][0] < BETWEEN[False]:
                break
            changed, last = changed + 1, z
            if changed <= SHARE[False] * (z - first) and z - first > best[1] - best[0]:
                best = first, z
    return best


def _runs(same: np.ndarray, size: int) -> np.ndarray:
    """Where a run of so many equal tokens begins, on each diagonal."""
    if len(same) < size:
        return np.zeros((0, same.shape[1]), dtype=bool)
    out = same[: len(same) - size + 1].copy()
    for j in range(1, size):
        out &= same[j : len(same) - size + 1 + j]
    return out


def stretch_in_band(item: np.ndarray, doc: np.ndarray, diagonal: int, weights: np.ndarray, han: bool) -> int:
    """Weight of the longest stretch of the item that the document holds near a diagonal (place in doc less place in item), by dynamic programming over a band.

    Runs of equal tokens are joined where a change of at most GAP tokens on either
    side, STEP more on one than on the other, parts them, BETWEEN equal ones apart, and
    the changed tokens are no more than SHARE of the stretch.
    """
    n, band = len(item), BAND[han]
    padded = np.zeros(n + 2 * band, dtype=np.uint64)  # 0 is the code of no token
    first = diagonal - band
    lo, hi = max(0, first), min(len(doc), first + len(padded))
    if hi <= lo:
        return 0
    padded[lo - first : hi - first] = doc[lo:hi]
    same = np.ndarray((n, 2 * band + 1), np.uint64, padded, strides=padded.strides * 2) == item[:, None]
    # Exact necessary conditions first. A stretch with so few changes has a long run on one diagonal, and a part of least length with few tokens outside of runs.
    runs = _runs(same, BETWEEN[han])
    if not (runs if han else runs[:-3] & runs[3:]).any():
        return 0
    begun, inside = runs.any(axis=1), np.zeros(n, dtype=bool)
    for j in range(BETWEEN[han]):
        inside[j : j + len(runs)] |= begun
    covered = np.concatenate([[0], (weights * inside).cumsum()])
    reach = LEAST[han] if not han else n
    if reach <= n and (covered[reach:] - covered[:-reach]).max() < (LEAST[han] - 8 if not han else (1 - SHARE[True]) * LEAST[han]):
        return 0
    # Where the run of equal tokens that a token is in ends, on each diagonal of the band.
    free = np.where(same, n, np.arange(n)[:, None])
    stop = np.minimum.accumulate(free[::-1], axis=0)[::-1]
    total = np.concatenate([[0], weights.cumsum()])
    least, gap, step, best = BETWEEN[han], GAP[han], STEP[han], 0
    begins = same.copy()
    begins[1:] &= ~same[:-1]
    todo: list[dict[int, dict[int, int]]] = [{} for _ in range(n + 1)]  # by the end of a run: diagonal, tokens changed so far: first token
    for i, k in zip(*np.nonzero(begins)):
        z = int(stop[i, k])
        if not han or z - i >= least:
            todo[z].setdefault(int(k), {})[0] = int(i)
    for end in range(1, n + 1):
        for k, states in todo[end].items():
            for changed, start in sorted(states.items()):
                weight = int(total[end] - total[start])
                if weight > best and changed <= SHARE[han] * (weight if han else end - start):
                    best = weight
                if changed + 1 > SHARE[han] * int(total[n] - total[start]):
                    continue
                for d in range(-step, step + 1):
                    if not 0 <= k + d <= 2 * band:
                        continue
                    for skip in range(max(0, -d), gap + 1 - max(0, d)):  # tokens of the item left out; skip + d of the document
                        at = end + skip
                        if at >= n or not (skip or d) or not same[at, k + d]:
                            continue
                        z = int(stop[at, k + d])
                        if z - at < least and (han or z < n and z - at < 1):
                            continue
                        cost = changed + max(skip, skip + d)
                        if z - at < least:  # too short to stand between two changes: it may only end the stretch
                            weight = int(total[z] - total[start])
                            if weight > best and cost <= SHARE[han] * (weight if han else z - start):
                                best = weight
                            continue
                        known = todo[z].setdefault(k + d, {})
                        if start < known.get(cost, n):
                            known[cost] = start
    return best


def weights_of(words: list[str], han: bool) -> np.ndarray:
    """What each token counts in a stretch: one word, or its characters."""
    return np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if han else np.ones(len(words), dtype=np.int64)


def enough(item: np.ndarray, weights: np.ndarray, doc: np.ndarray, diagonal: int, han: bool) -> bool:
    """Whether the document holds, around a diagonal, a stretch of the item that counts. item, doc: codes; weights: of the item's tokens."""
    if not han:  # without shifts one comparison tells
        lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        if hi > lo:
            same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
            if np.count_nonzero(same) >= (1 - SHARE[False]) * LEAST_WORDS - 1e-6:
                start, end = stretch(same)
                if end - start >= LEAST_WORDS:
                    return True
    return stretch_in_band(item, doc, diagonal, weights, han) >= LEAST[han]


def probe(batches: Iterator[pd.DataFrame], indexes: dict[bool, Index]) -> Iterator[pd.DataFrame]:
    """(doc_id, item_id) of the batches (doc_id, text)."""
    vocabulary = Vocabulary()
    for b in bounded(batches):
        words = [tokenise(t) if t else [] for t in b["text"]]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)])
        codes = vocabulary.codes([w for ws in words for w in ws])
        out = set()
        script = han_tokens([w for ws in words for w in ws])
        for han, index in indexes.items():
            docs = np.flatnonzero(sizes >= index.window)
            starts = [base[d] + np.append(np.arange(0, sizes[d] - index.window, index.stride), sizes[d] - index.window) for d in docs]
            starts = index.possible(script, np.concatenate(starts) if starts else np.empty(0, dtype=np.int64))
            place, own = index.candidates(codes, starts)
            tried: dict[tuple[int, int], list[int]] = {}
            at = starts[place]
            doc = np.searchsorted(base, at, side="right") - 1
            for d, n, diagonal in zip(doc.tolist(), index.owner[own].tolist(), (at - base[doc] - index.offset[own]).tolist()):
                if (d, n) in out:
                    continue
                done = tried.setdefault((d, n), [])
                if any(abs(diagonal - x) <= BAND[han] // 2 for x in done):
                    continue
                done.append(diagonal)
                if enough(index.item_codes(n), index.weights[n], codes[base[d] : base[d + 1]], diagonal, han):
                    out.add((d, n))
            if out:
                rows = [(b["doc_id"].iloc[d], index.ids[n]) for d, n in out]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])
                out = set()


def window_keys(batches: Iterator[pd.DataFrame], every: bool) -> Iterator[pd.DataFrame]:
    """(key, id, at, han) of the windows of (id, text): of items at every offset in their own script, of documents at the stride in both."""
    vocabulary = Vocabulary()
    for b in bounded(batches):
        for i, text in zip(b["id"], b["text"]):
            words = tokenise(text)
            codes = vocabulary.codes(words)
            own = is_han(words)
            for han in (own,) if every else (False, True):
                window, stride = WINDOW[han]
                last = len(words) - window
                if last < 0:
                    continue
                starts = np.arange(last + 1) if every else np.append(np.arange(0, last, stride), last)
                if not every and han and not han_tokens(words).any():
                    continue
                for rep in range(REPS):
                    key = embed(codes, starts, window, rep) + np.uint64(han)
                    yield pd.DataFrame({"key": key.view(np.int64), "id": i, "at": starts, "han": han})


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, item_id) of the rows (doc_id, item_id, text, item, diagonals, han) that hold a stretch that counts."""
    vocabulary = Vocabulary()
    for b in bounded(batches):
        out = []
        for d, n, text, item, diagonals, han in b[["doc_id", "item_id", "text", "item", "diagonals", "han"]].itertuples(index=False, name=None):
            words = tokenise(item)
            codes, doc, done = vocabulary.codes(words), vocabulary.codes(tokenise(text)), []
            weights = weights_of(words, han)
            for x in sorted(diagonals):
                if not done or x - done[-1] > BAND[han] // 2:
                    done.append(x)
                    if enough(codes, weights, doc, int(x), han):
                        out.append((d, n))
                        break
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])


def is_han(words: list[str]) -> bool:
    return sum(bool(HAN.match(w)) for w in words) * 2 > len(words)


def joined_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for items of any size: keys are joined, hot ones salted, and pairs of texts verified where they collide."""
    schema = "key long, id long, at int, han boolean"
    own = durable(items.select(F.col("item_id").alias("id"), "text").mapInPandas(lambda b: window_keys(b, True), schema), "item-keys")
    probes = durable(docs.select(F.col("doc_id").alias("id"), "text").mapInPandas(lambda b: window_keys(b, False), schema), "doc-keys")
    most = max(HOT, (own.count() + probes.count()) // MOST_HOT)  # so that no more than MOST_HOT keys can be hot
    hot = small(own.select("key").unionByName(probes.select("key")).groupBy("key").count().filter(F.col("count") > most).select("key", F.lit(True).alias("hot")), MOST_HOT)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "at"), F.lit(SALTS))).otherwise(0)
    left = probes.join(hot, "key", "left").select("key", salt.cast("int").alias("salt"), F.col("id").alias("doc_id"), F.col("at").alias("a"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = own.join(hot, "key", "left").select("key", F.explode(salts).alias("salt"), F.col("id").alias("item_id"), F.col("at").alias("z"), "han")
    met = left.join(right, ["key", "salt"]).select("doc_id", "item_id", "han", (F.col("a") - F.col("z")).alias("x")).distinct()
    pairs = met.groupBy("doc_id", "item_id", "han").agg(F.collect_list("x").alias("diagonals"))  # of one document and one item: no more than their windows
    return pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").mapInPandas(verified, "doc_id long, item_id long").distinct()


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): one row for each document and item of which it holds a stretch of LEAST_WORDS words (LEAST_CHARS characters).

    Up to BLOCK characters of items, counted first, are broadcast as an index, and
    documents are scanned in place; more items are joined on window keys. Items and
    documents shorter than a window, null texts and rows without identifier have no
    hits; repeated rows give one row.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    ids = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").distinct()
    if (ids.agg(F.sum(F.length("text"))).first()[0] or 0) > BLOCK:
        return joined_leaks(docs, ids)
    split: dict[bool, list[tuple[int, list[str]]]] = {False: [], True: []}
    for r in ids.toLocalIterator():
        words = tokenise(r["text"])
        split[is_han(words)].append((r["item_id"], words))
    shared = spark.sparkContext.broadcast({han: Index(x, han) for han, x in split.items() if x})
    return docs.mapInPandas(lambda batches: probe(batches, shared.value), "doc_id long, item_id long").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, source, split, documents): how many documents hold each item, 0 included."""
    found = find_leaks(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id", "source", "split").join(found, "item_id", "left").fillna(0, ["documents"])
