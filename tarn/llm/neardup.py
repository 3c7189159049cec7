"""Groups of near-duplicate records, by anchor points of a covering code.

Each distinct text gets a fingerprint of minhashes of its character bigrams,
arranged as TABLES words. A word is a block of 23 bits, taken from three
minhashes, and an exact part of two more. The anchors of a block are the 4,096
words of the binary Golay code, whose covering radius is 3: every block lies
within 3 bits of exactly one anchor, its home. The trivial code of radius 0
covers the exact part. A fingerprint is replicated to every anchor within
covering radius plus threshold, 3 + 1, about 5.3 for each word, and compared
there with the fingerprints at home. Blocks that differ in one bit always meet,
and of those that differ in one of their three minhashes about one in four.

Only the words are shuffled, by their exact part; replicas are made where they
are compared. A pair that met is compared by a sketch of 128 bits, then by one of 192, then
by the text. The chance of meeting depends on the Jaccard similarity J of the
bigrams: for one table it is 0.09 at 0.55, 0.13 at 0.60 and 0.18 at 0.65, for all of them 0.92, 0.975 and
0.994. Of pairs at trigram Dice 0.70 to 0.75, J is about 0.6 if all edits stand in
one run and 0.68 if they are scattered: 97 % and over 99 % of them meet; of pairs above 0.8 all but one of
a thousand. Where no link may be missed, ``exact`` adds what the anchors left apart: with the trigrams of every
text in one order, rare ones first, two texts that are similar enough must
share a trigram among the first of each (a prefix filter), and no bound used
there leaves out a similar pair.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._text import chunks
from tarn.llm.components import hash_to_min
from tarn.session import ship
from tarn.storage import Scratch

TABLES = 26
BLOCK = 23
RADIUS, THRESHOLD = 3, 1
GENERATOR = 0b101011100011  # of the binary Golay code
#: Bits that each minhash of a block gives, and minhashes of the exact part.
BLOCK_PARTS = (8, 8, 7)
EXACT_PARTS = 2
#: Minhashes of a text; a sketch has one bit of each.
HASHES = 192

#: Texts are near-duplicates if their trigram sets have at least this share in common (Dice).
SIMILARITY = 0.7
#: Bits in which a pair may differ in the first 128 of the sketch, and in the whole. Of pairs at Dice 0.70 to 0.75
#: whose edits stand in one run, the least alike by their bigrams, 3 of 1,000 exceed 40 and 55.
MOST_SHORT, MOST_BITS = 41, 58
#: Fingerprints of one exact part that are compared at once; more of them are linked by representatives first.
GROUP_ROWS = 20_000
#: Rows of one anchor in a task when the members of different classes are compared there.
SALT_ROWS = 20_000
#: Trigrams are counted in this many buckets to be put in order; any order gives the same links.
BUCKETS = 1 << 18
#: Words of 64 bits of a text's parity map, each bit the parity of the trigrams that fall on it.
PARITY = 8
#: Pairs at a trigram that are looked at together.
PAIRS_AT_ONCE = 200_000

_MARKS = re.compile(r"[\W_]+")


def plain(c: Column) -> Column:
    """A text as it is compared: lower case, without blanks, marks and invisible characters."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (the constants are splitmix64's, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str, n: int) -> np.ndarray:
    """Hashes of the distinct character n-grams; of the text itself if it is shorter."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    n = max(1, min(n, len(cp)))
    v = np.full(max(0, len(cp) - n + 1), n, dtype=np.uint64)
    for j in range(n):
        v = v * np.uint64(1_114_129) + cp[j : len(cp) - n + 1 + j]
    return np.unique(_mix(v))


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    k = np.arange(1, HASHES + 1, dtype=np.uint64)
    return ((_mix(k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)


def minhashes(texts: list[str]) -> np.ndarray:
    """A row of HASHES minhashes of the character bigrams of each text (of the text itself if it is one character)."""
    cp = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    nxt = np.append(cp[1:], np.uint64(0))
    g = (_mix(cp * np.uint64(1_114_129) + nxt) >> np.uint64(32)).astype(np.uint32)
    m = _multipliers()
    out = np.full((len(texts), HASHES), np.iinfo(np.uint32).max, dtype=np.uint32)
    at = 0
    for i, t in enumerate(texts):
        n = max(1, len(t) - 1)
        for a in range(at, at + n, 2048):
            np.minimum(out[i], (g[a : min(a + 2048, at + n), None] * m[None, :]).min(axis=0), out=out[i])
        at += len(t) + 1
    return _mix(out.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketches (three words of 64 bits), blocks and exact parts of the words of each text; an exact part holds the number of its table."""
    h = minhashes(texts)
    sketch = np.packbits((h & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
    step = len(BLOCK_PARTS) + EXACT_PARTS
    use = h[:, : TABLES * step].reshape(len(texts), TABLES, step)
    block = np.zeros(use.shape[:2], dtype=np.int64)
    shift = 0
    for j, bits in enumerate(BLOCK_PARTS):
        block |= ((use[:, :, j] >> np.uint64(20)) & np.uint64((1 << bits) - 1)).astype(np.int64) << shift
        shift += bits
    exact = np.zeros(use.shape[:2], dtype=np.uint64)
    for j in range(len(BLOCK_PARTS), step):
        exact = _mix(exact + use[:, :, j])
    exact = (exact >> np.uint64(6)) | (np.arange(TABLES, dtype=np.uint64) << np.uint64(58))
    return sketch, block, exact.view(np.int64)


@lru_cache(maxsize=1)
def _code() -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Syndromes of the lower 12 and upper 11 bits of a block; for each syndrome the one error of weight up to RADIUS, and all up to RADIUS + THRESHOLD, filled up with -1."""
    single = np.zeros(BLOCK, dtype=np.int64)
    for i in range(BLOCK):
        r = 1 << i
        for b in range(BLOCK - 1, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        single[i] = r
    part = lambda n, first: np.bitwise_xor.reduce([np.where(np.arange(1 << n) >> i & 1, single[first + i], 0) for i in range(n)])
    home = np.zeros(1 << 11, dtype=np.int64)
    near: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + THRESHOLD + 1):
        for at in itertools.combinations(range(BLOCK), weight):
            s = int(np.bitwise_xor.reduce(single[list(at)])) if at else 0
            e = sum(1 << i for i in at)
            near[s].append(e)
            if weight <= RADIUS:
                home[s] = e
    wide = max(len(x) for x in near)
    return (part(12, 0), part(11, 12)), home, np.array([x + [-1] * (wide - len(x)) for x in near], dtype=np.int64)


def anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The home anchor of each block, and a row of all anchors it is replicated to, filled up with -1."""
    (low, high), home, near = _code()
    s = low[block & 4095] ^ high[block >> 12]
    to = near[s]
    return block ^ home[s], np.where(to >= 0, block[:, None] ^ to, -1)


def _fingerprints(batches):
    import pandas as pd

    for pdf in batches:
        texts = pdf["plain"].tolist()
        for a, b in chunks(texts, 200_000):
            sketch, block, exact = fingerprints(texts[a:b])
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[a:b], "s0": sketch[:, 0], "s1": sketch[:, 1], "s2": sketch[:, 2], "block": list(block.astype(np.int32)), "part": list(exact)})


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int16)


def _pairs_of_groups(part: np.ndarray, block: np.ndarray, key: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """Distinct pairs of keys of one exact part whose blocks meet at a home anchor and whose sketches are near; rows come sorted by part."""
    group = np.cumsum(np.append(True, part[1:] != part[:-1])) - 1
    use = np.flatnonzero(np.bincount(group)[group] > 1)
    home, to = anchors(block[use])
    at_home = (group[use] << BLOCK) | home
    order = np.argsort(at_home, kind="stable")
    at_home, to, use = at_home[order], to[order], use[order]
    group, key, s0, s1 = group[use], key[use], s0[use], s1[use]
    n = len(use)
    who, which = np.nonzero(to >= 0)
    visit = (group[who] << BLOCK) | to[who, which]
    lo = np.searchsorted(at_home, visit, "left")
    many = np.searchsorted(at_home, visit, "right") - lo
    who, lo, many = who[many > 0], lo[many > 0], many[many > 0]
    ends = np.cumsum(many)
    found = [np.zeros(0, dtype=np.int64)]
    start = 0
    while start < len(many):  # pairs are formed in bounded numbers
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        k = many[start:stop]
        y = np.repeat(who[start:stop], k)
        x = np.arange(k.sum()) + np.repeat(lo[start:stop] - (ends[start:stop] - k - done), k)
        first = _apart(s0[x], s0[y])
        near = np.flatnonzero((first <= MOST_SHORT) & (x != y))
        x, y, first = x[near], y[near], first[near]
        near = first + _apart(s1[x], s1[y]) <= MOST_SHORT
        x, y = x[near], y[near]
        found.append(np.minimum(x, y) * n + np.maximum(x, y))
        start = stop
    code = np.unique(np.concatenate(found))
    return np.stack([key[code // n], key[code % n]], axis=1) if n else np.zeros((0, 2), dtype=np.int64)


def _met_at_anchors(group_rows: int):
    """Rows come sorted by exact part. Groups of up to ``group_rows`` give all pairs that meet; larger ones give pairs with the first at each home anchor, and a row (part, part)."""

    def run(batches):
        import pandas as pd

        show = lambda p: pd.DataFrame({"a": p.min(axis=1), "b": p.max(axis=1)})
        held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 5
        hot, leads = None, {}

        def led(rows: list[np.ndarray]) -> np.ndarray:
            """Pairs of the rows of the hot group with the first row at their home anchor."""
            home, _ = anchors(rows[1])
            u, first = np.unique(home, return_index=True)
            for h, i in zip(u.tolist(), first.tolist(), strict=True):
                leads.setdefault(h, tuple(int(c[i]) for c in rows[2:]))
            lead = np.array([leads[h] for h in home.tolist()], dtype=np.int64).reshape(-1, 3)
            ok = (lead[:, 0] != rows[2]) & (_apart(lead[:, 1], rows[3]) + _apart(lead[:, 2], rows[4]) <= MOST_SHORT)
            return np.stack([lead[ok, 0], rows[2][ok]], axis=1)

        for pdf in batches:
            new = [pdf[c].to_numpy().astype(np.int64) for c in ("part", "block", "key", "s0", "s1")]
            if hot is not None:
                n = int(np.argmax(np.append(new[0] != hot, True)))
                yield show(led([c[:n] for c in new]))
                if n == len(new[0]):
                    continue
                hot, leads = None, {}
                new = [c[n:] for c in new]
            held = [np.concatenate([h, c]) for h, c in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            last = held[0][-1]
            open_ = int(np.argmax(held[0] == last))  # rows of the last group, which may go on
            if len(held[0]) - open_ > group_rows:
                hot = last
                yield show(_pairs_of_groups(*[c[:open_] for c in held]))
                yield pd.DataFrame({"a": [last], "b": [last]})
                yield show(led([c[open_:] for c in held]))
                held = [c[:0] for c in held]
            elif open_ > 4 * group_rows:
                yield show(_pairs_of_groups(*[c[:open_] for c in held]))
                held = [c[open_:] for c in held]
        yield show(_pairs_of_groups(*held))

    return run


def _spread(batches):
    """All anchors of the words of hot groups: (anchor, key, s0, s1, home)."""
    import pandas as pd

    for pdf in batches:
        part, block = pdf["part"].to_numpy(), pdf["block"].to_numpy().astype(np.int64)
        home, to = anchors(block)
        who, which = np.nonzero(to >= 0)
        at = to[who, which]
        anchor = _mix(part[who].view(np.uint64) ^ _mix(at.astype(np.uint64))).view(np.int64)
        yield pd.DataFrame({"anchor": anchor, "key": pdf["key"].to_numpy()[who], "s0": pdf["s0"].to_numpy()[who], "s1": pdf["s1"].to_numpy()[who], "home": at == home[who]})


def _dice(batches):
    import pandas as pd

    for pdf in batches:
        known: dict[int, np.ndarray] = {}
        keep = np.zeros(len(pdf), dtype=bool)
        for i, (a, b, ta, tb) in enumerate(zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True)):
            for k, t in ((a, ta), (b, tb)):
                if k not in known:
                    known[k] = grams(t, 3)
            x, y = known[a], known[b]
            keep[i] = 2 * len(np.intersect1d(x, y, assume_unique=True)) >= SIMILARITY * (len(x) + len(y)) - 1e-9
        yield pd.DataFrame({"a": pdf["a"].to_numpy()[keep], "b": pdf["b"].to_numpy()[keep]})


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that are near-duplicates by their whole texts."""
    t = texts.select("key", "plain")
    both = pairs.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(_dice, "a long, b long")


def _verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of keys that are near-duplicates by their text; sketches sort out the rest first."""
    s = [f"s{i}" for i in range(3)]
    fp = prints.select("key", *s)
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in s), F.lit(0))
    near = pairs.join(fp.toDF("a", *[f"a{c}" for c in s]), "a").join(fp.toDF("b", *[f"b{c}" for c in s]), "b").where(apart <= MOST_BITS).select("a", "b")
    return scratch.cut(_alike(near, texts), "links")


def _least(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    """The fewest trigrams that texts of n and m have in common if they are near-duplicates."""
    return np.ceil(np.asarray(n + m) * (SIMILARITY / 2) - 1e-9).astype(np.int64)


def _bucket(g: np.ndarray) -> np.ndarray:
    return (_mix(g.view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_counts(batches):
    import pandas as pd

    n = np.zeros(BUCKETS, dtype=np.int64)
    for pdf in batches:
        for g in pdf["grams"]:
            np.add.at(n, _bucket(np.asarray(g)), 1)
    at = np.flatnonzero(n)
    yield pd.DataFrame({"bucket": at, "n": n[at]})


def _prefixes(counts: np.ndarray):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                part = pdf.iloc[start : start + 1000]
                out: list[list[np.ndarray]] = [[], [], [], []]
                maps, sizes = [], []
                for grams_ in part["grams"]:
                    g = np.asarray(grams_)
                    n = len(g)
                    g = g[np.lexsort((g, counts[_bucket(g)]))]
                    least = int(np.ceil(n * (SIMILARITY / 2) / (1 - SIMILARITY / 2) - 1e-9))  # size of the smallest text that resembles this one
                    long, short = n - int(_least(n, least)) + 1, n - int(_least(n, n)) + 1
                    bits = np.bincount((g.view(np.uint64) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
                    maps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                    sizes.append(long)
                    for to, v in zip(out, (g[:long], np.arange(long), np.arange(long) < short, np.full(long, n)), strict=True):
                        to.append(v)
                each = np.repeat(np.arange(len(part)), sizes)
                m = np.array(maps)[each]
                yield pd.DataFrame({"gram": np.concatenate(out[0]), "key": part["key"].to_numpy()[each], "c": part["c"].to_numpy()[each], "at": np.concatenate(out[1]), "n": np.concatenate(out[3]), "short": np.concatenate(out[2])} | {f"m{i}": m[:, i] for i in range(PARITY)})

    return run


def _sharing(pdf, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x of ``a`` and y of ``b``, all of one trigram, that may be near-duplicates: no bound here rules out one that is."""
    key, c, at, n, m = pdf["key"], pdf["c"], pdf["at"], pdf["n"], pdf["m"]
    xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
    for s in range(0, len(a), step):
        x = a[s : s + step, None]
        both = n[x] + n[b]
        # the first trigram that two texts share is this one or an earlier one: as many as are left on both sides can follow
        ok = np.minimum(n[x] - at[x], n[b] - at[b]) >= both * (SIMILARITY / 2) - 1e-9
        ok &= (c[x] != c[b]) & ((n[x] < n[b]) | ((n[x] == n[b]) & (key[x] < key[b])))
        i, j = np.nonzero(ok)
        x, y = a[s + i], b[j]
        apart = np.bitwise_count((m[x] ^ m[y]).view(np.uint64)).sum(axis=1, dtype=np.int64)  # at most the trigrams that only one of them has
        keep = apart <= (n[x] + n[y]) * (1 - SIMILARITY) + 1e-9
        xs.append(x[keep])
        ys.append(y[keep])
    return np.concatenate(xs), np.concatenate(ys)


def _meeting(batches):
    """Rows come sorted by trigram. At each, rows of the largest class are never paired with each other."""
    import pandas as pd

    def pairs(pdf):
        gram = pdf["gram"].to_numpy()
        d = {k: pdf[k].to_numpy() for k in ("key", "c", "at", "n")} | {"m": pdf[[f"m{i}" for i in range(PARITY)]].to_numpy()}
        short = pdf["short"].to_numpy()
        cut = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        ends = np.append(cut[1:], len(gram))
        for s, e in zip(cut[ends - cut > 1].tolist(), ends[ends - cut > 1].tolist(), strict=True):
            rows = np.arange(s, e)
            u, inv = np.unique(d["c"][s:e], return_inverse=True)
            if len(u) == 1:
                continue
            top = inv == np.bincount(inv).argmax()
            for x, y in ((rows[short[s:e] & ~top], rows), (rows[short[s:e] & top], rows[~top])):
                i, j = _sharing(d, x, y)
                if len(i):
                    a, b = d["key"][i], d["key"][j]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def joined(parts):
        done = list(parts)
        if done:
            yield pd.concat(done).drop_duplicates()

    left: list = []
    for pdf in batches:
        last = pdf["gram"].iloc[-1] if len(pdf) else None
        if last is None:
            continue
        if pdf["gram"].iloc[0] == last and (not left or left[0]["gram"].iloc[0] == last):
            left.append(pdf)
            continue
        open_ = (pdf["gram"] == last).to_numpy()
        yield from joined(pairs(pd.concat([*left, pdf[~open_]])))
        left = [pdf[open_]]
    if left:
        yield from joined(pairs(pd.concat(left)))


def _trigrams(batches):
    import pandas as pd

    for pdf in batches:
        for start in range(0, len(pdf), 500):
            part = pdf.iloc[start : start + 500]
            yield pd.DataFrame({"key": part["key"], "c": part["c"], "grams": [grams(t, 3).view(np.int64) for t in part["plain"]]})


def missing_links(keyed: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between near-duplicate keys that ``links`` leaves in different classes: all of them, by an exact prefix filter."""
    comp = hash_to_min(links, scratch).toDF("key", "c")
    classed = keyed.select("key", "plain").join(comp, "key", "left").select("key", F.coalesce("c", "key").alias("c"), "plain")
    texts = scratch.cut(classed.mapInPandas(_trigrams, "key long, c long, grams array<long>"), "classed")
    n = texts.select("grams").mapInPandas(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[n["bucket"].to_numpy(dtype=np.int64)] = n["n"].to_numpy()
    maps = ", ".join(f"m{i} long" for i in range(PARITY))
    rows = texts.mapInPandas(_prefixes(counts), f"gram long, key long, c long, at int, n int, short boolean, {maps}")
    met = rows.repartition(spark_partitions(keyed), "gram").sortWithinPartitions("gram").mapInPandas(_meeting, "a long, b long").distinct()
    met = scratch.cut(met, "shared")
    out = scratch.cut(_alike(met, keyed), "late-links")
    scratch.drop(texts, met)
    return out


def near_links(prints: DataFrame, texts: DataFrame, scratch: Scratch, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between near-duplicate keys that meet at anchors; enough of them that each class is connected as by all of them.

    Groups of one exact part with more than ``group_rows`` rows would cost the
    square of a large class. There, each key is first compared with the first at its home anchor
    only, and classes are formed; then one key of each class that visits an anchor is compared
    with the smallest one at home, and classes are formed again; last, whoever is not in the
    anchor's largest class is compared with all members of other classes, in salted parts. Pairs
    within a class are left out as they are connected already; no pair of different classes is.
    """
    rows = prints.select("key", "s0", "s1", F.explode(F.arrays_zip("block", "part")).alias("w")).select("w.part", "w.block", "key", "s0", "s1")
    met = rows.repartition(max(12, spark_partitions(prints)), "part").sortWithinPartitions("part").mapInPandas(_met_at_anchors(group_rows), "a long, b long")
    met = scratch.cut(met.distinct(), "met")
    links = _verified(met.where("a <> b"), prints, texts, scratch)
    hot = met.where("a = b").select(F.col("a").alias("part"))
    if hot.isEmpty():
        scratch.drop(met)
        return links
    spread = scratch.cut(rows.join(hot, "part", "left_semi").mapInPandas(_spread, "anchor long, key long, s0 long, s1 long, home boolean"), "spread")

    def classed(links: DataFrame) -> DataFrame:
        comp = hash_to_min(links, scratch).toDF("key", "c")
        return spread.join(comp, "key", "left").select("anchor", "key", F.struct("s0", "s1").alias("s"), "home", F.coalesce("c", "key").alias("c"))

    near = F.bit_count(F.col("sx.s0").bitwiseXOR(F.col("sy.s0"))) + F.bit_count(F.col("sx.s1").bitwiseXOR(F.col("sy.s1"))) <= MOST_SHORT
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    one = classed(links).groupBy("anchor", "c").agg(F.min(F.struct(F.col("key").alias("y"), F.col("s").alias("sy"))).alias("y"), F.min(F.when(F.col("home"), F.struct(F.col("key").alias("x"), F.col("s").alias("sx")))).alias("x"))
    one = scratch.cut(one, "representatives")
    lead = one.groupBy("anchor").agg(F.min("x").alias("x")).where("x is not null").select("anchor", "x.*")
    late = one.select("anchor", "y.*").join(lead, "anchor").where((F.col("x") != F.col("y")) & near).select(*pair).distinct()
    links = links.union(_verified(late, prints, texts, scratch))
    all_ = scratch.cut(classed(links), "members")
    sizes = all_.groupBy("anchor", "c").agg(F.count("*").alias("n"))
    top = sizes.groupBy("anchor").agg(F.max_by("c", F.struct("n", "c")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
    all_ = all_.join(top.select("anchor", "top", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")), "anchor")
    few = all_.where("c <> top").select("anchor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("key").alias("x"), F.col("s").alias("sx"), F.col("c").alias("cx"), F.col("home").alias("hx"))
    many = all_.select("anchor", F.pmod(F.xxhash64("key"), "salts").cast("int").alias("salt"), F.col("key").alias("y"), F.col("s").alias("sy"), F.col("c").alias("cy"), F.col("home").alias("hy"))
    rest = few.join(many, ["anchor", "salt"]).where((F.col("hx") | F.col("hy")) & (F.col("cx") != F.col("cy")) & near).select(*pair).distinct()
    links = links.union(_verified(rest, prints, texts, scratch))
    scratch.drop(met, spread, one)
    return links


def near_duplicates(df: DataFrame, id_col: str, text: Sequence[str], scratch: Scratch, exact: bool = False, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Classes of near-duplicate records: rows (id, class, copies, links), and the links between distinct texts.

    ``text`` names the columns that are compared together. Records are
    near-duplicates if the character trigrams of their plain texts (``plain``:
    letters and digits only, whole texts) have a Dice similarity of at least
    SIMILARITY; a class is what such links connect. Records of one plain text
    are one point: copies are linked to each other and never compared. A class
    is named by its smallest id and ``copies`` counts the ids of the record's own
    plain text. Links are those of a class's smallest text, its representative, with each other text
    of the class, so that they do not depend on how the class was found: ``links`` is 1 for a text
    and, for the representative, the number of the other texts. Records in no class of two or more are left out.

    Links are sought at anchors (see the module for the chance that a pair near the limit meets);
    with ``exact`` also by the prefix filter, which finds all the rest at a cost that grows with the
    square of the texts where the vocabulary stays the same.

    Rows with a null id are left out; repeated rows of an id count once, by the
    greatest text; null columns are empty; records whose plain text is empty
    resemble nothing. An empty table gives empty results.
    """
    ship(df.sparkSession)
    t = plain(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text]))
    rows = df.select(F.col(id_col).alias("id"), t.alias("plain")).where("id is not null").groupBy("id").agg(F.max("plain").alias("plain")).where("plain <> ''")
    # the key of a text is a 64-bit hash: two of a billion texts share one with a chance of 3 %
    keyed = scratch.cut(rows.select("id", F.xxhash64("plain").alias("key"), "plain"), "records")
    texts = scratch.cut(keyed.groupBy("key").agg(F.min("plain").alias("plain"), F.count("*").alias("copies"), F.min("id").alias("first")), "texts")
    schema = "key long, s0 long, s1 long, s2 long, block array<int>, part array<long>"
    prints = scratch.cut(texts.select("key", "plain").repartition(max(12, spark_partitions(df))).mapInPandas(_fingerprints, schema), "prints")
    links = near_links(prints, texts, scratch, group_rows)
    if exact:
        links = scratch.cut(links.union(missing_links(texts, links, scratch)).distinct(), "all-links")
    comp = hash_to_min(links, scratch).toDF("key", "c")
    own = texts.select("key", "copies", "first").join(comp, "key", "left").select("key", "copies", "first", F.coalesce("c", "key").alias("c"))
    own = scratch.cut(own, "own")
    named = own.groupBy("c").agg(F.min(F.struct("first", "key")).alias("r"), F.sum("copies").alias("size"), F.count("*").alias("texts")).where("size > 1")
    named = scratch.cut(own.join(named, "c").select("key", "copies", "first", F.col("r.first").alias("class"), (F.when(F.col("key") == F.col("r.key"), F.col("texts") - 1).otherwise(1)).cast("long").alias("links")), "named")
    out = keyed.select("id", "key").join(named.select("key", "class", "copies", "links"), "key").select("id", "class", "copies", "links")
    edges = named.where("first <> class").select(F.col("class").alias("id_a"), F.col("first").alias("id_b"))
    out = scratch.cut(out, "classes")
    scratch.drop(texts, prints, own)
    return out, edges


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def class_pairs(classes: DataFrame) -> DataFrame:
    """Every pair id_a < id_b within a class: as many rows as a class has pairs, for small classes or where all are wanted."""
    a, b = classes.select("class", F.col("id").alias("id_a")), classes.select("class", F.col("id").alias("id_b"))
    return a.join(b, "class").where("id_a < id_b").select("id_a", "id_b")
