"""N-gram Jaccard join by vertical partitioning.

All holders of an n-gram meet by its hash, so its document frequency is exact; n-grams of a
single set are dropped, and sets with too few others can link with nothing. The rest is put in
one global order, by frequency and then by hash; two similar sets share an n-gram of their
prefixes in that order. The order is cut into fragments at PIVOTS; the overlap of a candidate
pair is counted in each fragment separately, and the partial overlaps are summed per pair.

Equal sets are one class from the start. A list of classes that share a prefix n-gram is first
compared with one pivot per round, then in full, but for classes that are in one component
already; lists whose classes have all been joined need no more. A pair is drawn only where the
sizes and what follows the n-gram in both sets leave room for enough overlap. No pair that could
join two components is left out. Members of one component are not compared again; the pairs
between components that pass the bounds in the full comparison have no proven limit.

Words are hashed with BLAKE2b to 64 bits, n-grams to 64 bits of their words' hashes, sets to a
128-bit BLAKE2b digest of their n-grams. What passes the count is only a proposal: the two texts
are fetched, and a link stands if their n-grams, compared word by word, are similar enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, mixed, spare_memory, text_bytes, word_hashes, words_in

WIDTH, PERCENT = 5, 75
#: Text bytes per fragment of the hash space, n-grams gathered before they are sent, holders in one gathering from which an n-gram is heavy, n-grams of a fragment that are sorted at once.
FRAGMENT_BYTES, GATHER, HEAVY, SORTED = 24 << 20, 1_000_000, 128, 500_000
#: Document frequencies at which the global order is cut into the fragments that overlaps are counted in; rounds with pivots before the full comparison.
PIVOTS, ROUNDS = (3, 6, 24), 2
#: Texts hashed at once.
SLICE = 512
_ODD = 0xC2B2AE3D27D4EB4F
#: 128-bit digest of a set.
CLASS = np.dtype([("a", "<i8"), ("b", "<i8")])


def shingles(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit n-gram numbers of each whole text: A-Z lowered, the whole sequence if it is short, none without words."""
    words, index, counts = words_in(texts)
    h = word_hashes(words)[index]
    powers = [np.uint64(pow(_ODD, width - 1 - k, 1 << 64)) for k in range(width)]
    m = max(0, len(h) - width + 1)
    all_ = np.zeros(m, np.uint64)
    for k in range(width):
        all_ += h[k : k + m] * powers[k]
    all_ = mixed(all_ + np.uint64(width))
    at = 0
    for n in counts.tolist():
        if n >= width:
            s = np.sort(all_[at : at + n - width + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s
        elif n:
            yield mixed((h[at : at + n] * powers[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
        at += n


def similar(a: str, b: str, width: int = WIDTH, percent: int = PERCENT) -> bool:
    """Whether two texts link, by their n-grams themselves: windows of words, numbered in a dictionary that both texts share."""
    _, index, counts = words_in(pa.array([a, b], pa.large_string()))
    sets = []
    for x in (index[: counts[0]], index[counts[0] :]):
        if len(x) < width:
            sets.append(np.r_[-np.ones(width - len(x), np.int64), x][None] if len(x) else np.zeros((0, width), np.int64))
        else:
            sets.append(np.unique(np.lib.stride_tricks.sliding_window_view(x, width), axis=0))
    both = np.concatenate(sets)
    union = len(np.unique(both, axis=0))
    return len(both) > union and 100 * (len(both) - union) >= percent * union


RUNS = "frag int, at long, kind string, docs binary, classes binary, sizes binary, counts binary, keys binary, ranks binary"
_RUNS = pa.schema([("frag", pa.int32()), ("at", pa.int64()), ("kind", pa.string()), *[(x, pa.binary()) for x in ("docs", "classes", "sizes", "counts", "keys", "ranks")]])


def _row(frag: int, at: int, kind: str, docs=b"", classes=b"", sizes=b"", counts=b"", keys=b"", ranks=b"") -> tuple:
    return frag, at, kind, docs, classes, sizes, counts, keys, ranks


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _binaries(x: np.ndarray) -> pa.Array:
    """Fixed-width values as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * x.dtype.itemsize), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _numbered(runs: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (classes, sizes, counts): the distinct classes, their sizes, and the class's number of every n-gram."""
    c, size, n = (np.concatenate([np.frombuffer(r[k], t) for r in runs]) for k, t in ((0, CLASS), (1, "<i4"), (2, "<i4")))
    order = np.lexsort((c["b"], c["a"]))
    new = np.r_[True, c[order][1:] != c[order][:-1]]
    number = np.empty(len(c), np.int32)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return c[first], size[first], np.repeat(number, n)


class Gathering:
    """n-grams of some documents, sent out by fragment when there are enough."""

    def __init__(self, fragments: int, homes: int):
        self.fragments, self.homes = fragments, homes
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple] = []
        self.seen: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.classes: list[bytes] = []
        self.total = 0

    def add(self, doc: int | None, place: int, s: np.ndarray) -> None:
        c = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        self.docs.append((doc, place, c, len(s)))
        if len(s) and c not in self.seen:
            self.seen[c] = len(s)
            self.sets.append(s)
            self.classes.append(c)
            self.total += len(s)

    def sent(self) -> list[tuple]:
        out: list[tuple] = []
        if self.docs:
            ids = np.array([(0 if d is None else d, p) for d, p, _, _ in self.docs], "<i8").tobytes()
            null = bytes(d is None for d, *_ in self.docs)
            spread = int.from_bytes(self.docs[0][2][:7], "little") % self.homes
            out.append(_row(-1 - spread, spread, "docs", docs=ids, classes=b"".join(c for _, _, c, _ in self.docs), sizes=np.array([n for *_, n in self.docs], "<i4").tobytes(), ranks=null))
        if self.sets:
            s = np.concatenate(self.sets)
            size = np.array([len(x) for x in self.sets], "<i4")
            who = np.repeat(np.arange(len(size), dtype=np.int32), size)
            cls = np.frombuffer(b"".join(self.classes), CLASS)
            frag = (s % np.uint64(self.fragments)).astype(np.int32)
            heavy = np.zeros(len(s), bool)
            if len(size) >= HEAVY:
                u, inv, n = np.unique(s, return_inverse=True, return_counts=True)
                heavy = n[inv] >= HEAVY
            order = np.argsort(frag, kind="stable")
            bounds = np.searchsorted(frag[order], np.arange(self.fragments + 1))
            for f in range(self.fragments):
                i = order[bounds[f] : bounds[f + 1]]
                if not len(i):
                    continue
                hot = heavy[i]
                if hot.any():
                    out.append(_row(f, 0, "heavy", keys=np.unique(s[i[hot]]).tobytes()))
                    out += by_home(f, cls, size, who[i[hot]], s[i[hot]], np.full(int(hot.sum()), 255, np.uint8), self.homes, True)
                    i = i[~hot]
                w, n = np.unique(who[i], return_counts=True)
                out.append(_row(f, 0, "runs", classes=cls[w].tobytes(), sizes=size[w].tobytes(), counts=n.astype("<i4").tobytes(), keys=s[i].tobytes()))
        self.clear()
        return out


def by_home(f: int, classes: np.ndarray, sizes: np.ndarray, who: np.ndarray, key: np.ndarray, rank: np.ndarray, homes: int, passing: bool) -> list[tuple]:
    """Runs of one fragment dealt out by the home of their class; a row per home that gets any, so never more rows than n-grams. passing: they skip the fragment's own count."""
    home = (classes["a"].view("<u8") % np.uint64(homes)).astype(np.int64)[who]
    order = np.lexsort((who, home))
    out = []
    bounds = np.searchsorted(home[order], np.arange(homes + 1))
    for h in np.flatnonzero(np.diff(bounds)):
        i = order[bounds[h] : bounds[h + 1]]
        w, n = np.unique(who[i], return_counts=True)
        out.append(_row(-1 - int(h) if passing else f, int(h), "set", classes=classes[w].tobytes(), sizes=sizes[w].astype("<i4").tobytes(), counts=n.astype("<i4").tobytes(), keys=key[i].tobytes(), ranks=rank[i].tobytes()))
    return out


def _counted(table: pa.Table, homes: int) -> pa.Table:
    """One fragment: drops n-grams of one class, ranks the others by how many classes hold them.

    The n-grams stay in the table's own buffers; a part of the hash space is copied and sorted at a time, and only what is kept of it stays.
    """
    spare_memory()
    small = table.drop(["keys"]).to_pylist()
    keys = [x.as_buffer() for x in table.column("keys")]
    out = [(*r.values(),) for r in table.filter(pc.invert(pc.is_in(table.column("kind"), pa.array(["runs", "heavy"])))).to_pylist()]
    runs = [k for k, r in enumerate(small) if r["kind"] == "runs"]
    if runs:
        f = small[runs[0]]["frag"]
        classes, sizes, who = _numbered([(small[k]["classes"], small[k]["sizes"], small[k]["counts"]) for k in runs])
        key = [np.frombuffer(keys[k], "<u8") for k in runs]
        heavy = [np.frombuffer(keys[k], "<u8") for k, r in enumerate(small) if r["kind"] == "heavy"]
        heavy = np.unique(np.concatenate(heavy)) if heavy else None
        del small
        who = np.split(who, np.cumsum([len(x) for x in key])[:-1])
        parts = min(256, sum(map(len, key)) // SORTED + 1)
        part = [((x >> np.uint64(40)) % np.uint64(parts)).astype(np.uint8) for x in key]
        kept = [_ranked(*(np.concatenate([x[p == k] for x, p in zip(xs, part)]) for xs in (who, key)), heavy) for k in range(parts)]
        del key, part, who
        who, key, rank = (np.concatenate(x) for x in zip(*kept))
        del kept
        if len(key):
            out += by_home(f, classes, sizes, who, key, rank, homes, False)
    return pa.Table.from_batches([_table(out, _RUNS)])


def _ranked(who: np.ndarray, key: np.ndarray, heavy: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all holders of some n-grams: class number, n-gram and rank of those that are kept."""
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    new_key = np.r_[True, key[1:] != key[:-1]][: len(key)]
    one = new_key | np.r_[True, who[1:] != who[:-1]][: len(key)]  # copies sent by several tasks count once
    key, who, new_key = key[one], who[one], new_key[one]
    df = np.diff(np.r_[np.flatnonzero(new_key), len(key)])
    df = np.repeat(df, df)
    hot = np.isin(key, heavy) if heavy is not None else np.zeros(len(key), bool)
    keep = (df >= 2) | hot
    return who[keep], key[keep], np.where(hot, 255, np.minimum(df, 254)).astype(np.uint8)[keep]


SETS = "kind string, doc_id long, place long, class binary, n int, kept array<long>, cuts array<int>"
_SETS = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64()), ("class", pa.binary()), ("n", pa.int32()), ("kept", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int32()))])


def _assembled(table: pa.Table, percent: int) -> pa.Table:
    """One home: the documents' rows, and the sets of which enough is held by others, in the global order, with the places where its fragments begin."""
    spare_memory()
    out: list[pa.RecordBatch] = []
    parts, keys, ranks = [], [], []
    for r in table.to_pylist():
        if r["kind"] == "docs":
            null = np.frombuffer(r["ranks"], bool)
            n = len(null)
            ids, places = np.frombuffer(r["docs"], "<i8").reshape(n, 2).T
            out.append(pa.RecordBatch.from_arrays([pa.array(["doc"] * n), pa.array(ids, pa.int64(), mask=null), pa.array(places), _binaries(np.frombuffer(r["classes"], CLASS)), pa.array(np.frombuffer(r["sizes"], "<i4")), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))], schema=_SETS))
        else:
            parts.append((r["classes"], r["sizes"], r["counts"]))
            keys.append(r["keys"])
            ranks.append(r["ranks"])
    if parts:
        classes, sizes, who = _numbered(parts)
        token, rank = np.frombuffer(b"".join(keys), "<u8").view("<i8"), np.frombuffer(b"".join(ranks), np.uint8)
        order = np.lexsort((token, rank, who))
        who, token, rank = who[order], token[order], rank[order]
        one = np.r_[True, (who[1:] != who[:-1]) | (token[1:] != token[:-1])]
        who, token, rank = who[one], token[one], rank[one]
        held = np.bincount(who, minlength=len(classes))
        good = 100 * held >= percent * sizes
        if good.any():
            keep = good[who]
            offsets = np.r_[0, np.cumsum(held[good])].astype(np.int32)
            m = int(good.sum())
            below = [np.bincount(who[keep], weights=rank[keep] < p, minlength=len(classes))[good] for p in PIVOTS]
            cuts = np.stack([np.zeros(m), *below, held[good]], 1).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[keep]))
            cut = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * cuts.shape[1]), pa.array(cuts.ravel()))
            out.append(pa.RecordBatch.from_arrays([pa.array(["set"] * m), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), _binaries(classes[good]), pa.array(sizes[good].astype(np.int32)), kept, cut], schema=_SETS))
    return pa.Table.from_batches(out, _SETS)


def sets_of(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Rows of all documents (doc_id, place, class, n; place: a hash of the text) and of the classes that may link (class, n, kept, cuts)."""
    docs = docs.select(F.col(key).cast("long"), F.col(text), F.xxhash64(text))
    fragments = _fragments(docs, text)
    homes = fragments

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gathering(fragments, homes)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc, place, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), shingles(part.column(1))):
                    g.add(doc, place, s)
                    if g.total >= GATHER or len(g.docs) >= 100_000:
                        yield _table(g.sent(), _RUNS)
        yield _table(g.sent(), _RUNS)
        spare_memory()

    sent = docs.mapInArrow(send, RUNS)
    counted = sent.groupBy("frag").applyInArrow(lambda t: _counted(t, homes), RUNS)
    return counted.groupBy("at").applyInArrow(lambda t: _assembled(t, percent), SETS)


def _fragments(docs: DataFrame, text: str) -> int:
    least = min(24, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, text_bytes(docs, text) // FRAGMENT_BYTES + 1)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the smallest node it is linked to) for every node of the edges u, v: large-star and small-star steps until only stars are left."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    k = 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        e = scratch.save(f"{name}-{k}", small)
        if k:
            scratch.drop(f"{name}-{k - 1}")
        # A node is a centre or has one centre: then each component is a star.
        sides = e.select("u", F.lit(1).alias("as_u")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("as_u")))
        if sides.groupBy("u").agg(F.sum("as_u").alias("n"), F.min("as_u").alias("low")).where("n > 1 or (n = 1 and low = 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        k += 1


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b (with na, nb and what else they carry) whose overlap is large enough: partial overlaps by fragment, summed."""
    def of_part(f: int):
        return F.slice("kept", F.get("cuts", F.lit(f)) + 1, F.get("cuts", F.lit(f + 1)) - F.get("cuts", F.lit(f)))

    cut = sets.select("class", F.posexplode(F.array(*map(of_part, range(len(PIVOTS) + 1)))).alias("f", "seg")).where(F.size("seg") > 0)
    a = pairs.join(cut.select(F.col("class").alias("a"), "f", F.col("seg").alias("seg_a")), "a")
    both = a.join(cut.select(F.col("class").alias("b"), "f", F.col("seg").alias("seg_b")), ["b", "f"])
    part = both.select(*pairs.columns, F.size(F.array_intersect("seg_a", "seg_b")).alias("part"))
    total = part.groupBy(*pairs.columns).agg(F.sum("part").alias("overlap"))
    return total.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap")))


def confirmed(links: DataFrame, rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The links a, b (with what else they carry) whose texts are similar n-gram by n-gram; each class is read in one of its texts."""
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    first = rows.join(ends, "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "place")).alias("at")).select("class", F.col("at.doc_id").alias("_id"), F.col("at.place").alias("_place"))
    found = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place"))).groupBy("class").agg(F.first("text").alias("text"))

    names = links.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("text_a", "text_b"))
            good = [similar(x[k].as_py(), y[k].as_py(), percent=percent) for k in range(batch.num_rows)]
            yield batch.select(names).filter(pa.array(good, pa.bool_()))

    both = links.join(found.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(found.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select(*names, "text_a", "text_b").mapInArrow(run, links.schema)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two holders of an n-gram can be similar if it is the first that they share: by their sizes, and by what follows it in both."""
    na, nb, ra, rb = (F.col(f"{x}.{y}") for y in ("n", "rest") for x in (a, b))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * F.least(ra, rb) >= percent * (na + nb))


def pairs_of(drawn: DataFrame) -> DataFrame:
    """Distinct pairs from the sides p, q of drawn, the smaller class as a."""
    less = F.col("p.class") < F.col("q.class")
    sides = [(F.when(less, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")), o) for c, o in (("class", ""), ("n", "n"), ("root", "r")) for x, y, o in (("p", "q", o + "a"), ("q", "p", o + "b"))]
    return drawn.select(*[c.alias(o) for c, o in sides]).distinct()


def merged(roots: DataFrame | None, links: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """class, root after links between roots ra, rb: every root takes the least within two links, which joins stars whole."""
    both = links.select(F.explode(F.array(F.struct(F.col("ra").alias("u"), F.col("rb").alias("v")), F.struct(F.col("rb").alias("u"), F.col("ra").alias("v")))).alias("e")).select("e.u", "e.v").distinct()
    both = scratch.save(f"edges-{k}", both)
    near = scratch.save(f"near-{k}", both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")))
    far = both.join(near, "v").groupBy("u").agg(F.min("m").alias("to"))
    if roots is None:
        out = far.select(F.col("u").alias("class"), F.col("to").alias("root"))
    else:
        # Roots that had no row yet are classes of their own.
        known = roots.join(far, roots["root"] == far["u"], "left").select("class", F.coalesce("to", "root").alias("root"))
        out = known.unionByName(far.join(roots, far["u"] == roots["class"], "left_anti").select(F.col("u").alias("class"), F.col("to").alias("root")))
    return scratch.save(f"roots-{k}", out)


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class, component_id, place, first of every row.

    place is a hash of the text. first tells the one row, by id (null last) and place, that stands
    for its component; rows that repeat both are alike.

    Null and empty texts have no n-grams and are components of their own; null ids belong to
    the component of their text and get its smallest id (null if it has none). Repeated rows
    stay. Ties need no rule: links are symmetric. An empty table gives none; other columns
    are not looked at. A text is held whole by the task that reads it, and the two texts of a
    link by the task that confirms it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    found = scratch.save("sets", sets_of(docs, key, text, percent))
    rows = found.where("kind = 'doc'").select("doc_id", "place", "class", "n")
    sets = found.where("kind = 'set'").select("class", "n", "kept", "cuts")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))
    need = F.ceil(F.col("n") * percent / F.lit(100.0)).cast("int")
    held = F.size("kept")
    prefix = sets.select("class", "n", held.alias("held"), F.posexplode(F.slice("kept", F.lit(1), held - need + 1)).alias("pos", "token"))
    lists = scratch.save("lists", prefix.select("token", "class", "n", (F.col("held") - F.col("pos")).alias("rest"), "held"))
    side = F.struct("class", "n", "rest", "root")
    roots = links = None  # roots: class, root of those that have been joined
    for k in range(ROUNDS + 1):
        named = lists.withColumn("root", F.col("class")) if roots is None else lists.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        # The first pivot has the fewest n-grams of its own: it is similar to most of a group of near copies.
        turn = F.struct(F.lit(0.0) if k else F.col("held") / F.col("n"), F.xxhash64("class", F.lit(k)))
        top = named.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max_by(side, turn).alias("p")).where("r0 <> r1")
        top = scratch.save(f"top-{k}", top.select("token", "p"))  # written, so that Spark splits the list of a hot n-gram in the join
        lists = scratch.save(f"open-{k}", named.join(top, "token"))
        if lists.isEmpty():
            break
        last = k == ROUNDS
        q = lists.select("token", side.alias("q"), "p")
        if last:
            drawn = q.drop("p").join(q.select("token", F.col("q").alias("p")), "token").where((F.col("p.class") < F.col("q.class")) & (F.col("p.root") != F.col("q.root")) & may_link("p", "q", percent))
        else:
            drawn = q.where((F.col("p.root") != F.col("q.root")) & may_link("p", "q", percent))
        lists = lists.select("token", "class", "n", "rest", "held")
        likely = scratch.save(f"likely-{k}", verified(pairs_of(drawn), sets, percent).select("a", "b", "ra", "rb"))
        good = scratch.save(f"links-{k}", confirmed(likely, rows, texts, percent))
        links = good if links is None else links.unionByName(good)
        if last:
            break
        if not good.isEmpty():
            roots = merged(roots, good, scratch, k)
    real = rows.where("n > 0")
    of_class = real.groupBy("class").agg(F.min("doc_id").alias("low"))
    if links is None or links.isEmpty():
        of_class = of_class.withColumn("root", F.col("class"))
    else:
        # Links between the roots as they are now; each class is at most one step from its root's component.
        def now(df: DataFrame, x: str, to: str) -> DataFrame:
            if roots is None:
                return df.withColumn(to, F.col(x))
            return df.join(roots.select(F.col("class").alias(x), F.col("root").alias(to)), x, "left").withColumn(to, F.coalesce(to, x))

        between = scratch.save("between", now(now(links.select("a", "b"), "a", "u"), "b", "v").where("u <> v").select("u", "v").distinct())
        if not between.isEmpty():
            stars = components(between, scratch, "cc").select(F.col("node").alias("root"), F.col("root").alias("to"))
            of_class = now(of_class, "class", "root").join(stars, "root", "left").select("class", "low", F.coalesce("to", "root").alias("root"))
        else:
            of_class = now(of_class, "class", "root")
    # Of each component the smallest id, and the first row: by id (null last), then by place.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    of_class = of_class.join(real.groupBy("class").agg(F.min(order).alias("head")), "class")
    of_root = of_class.groupBy("root").agg(F.min("low").alias("component_id"), F.min("head").alias("head"))
    of_class = of_class.join(of_root.withColumnRenamed("head", "of_root"), "root").select("class", "component_id", F.col("of_root").alias("head"))
    of_class = scratch.save("components", of_class)  # written, so that Spark splits the rows of a hot class in the join
    out = real.join(of_class, "class").withColumn("first", F.equal_null(order, "head")).drop("head")
    out = out.unionByName(rows.where("n = 0").withColumns({"component_id": F.col("doc_id"), "first": F.lit(True)}))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class", "component_id", "place", "first")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), c AS (
  SELECT doc_id AS a, doc_id AS root FROM documents
  UNION
  SELECT e.b, c.root FROM c JOIN e ON c.a = e.a WHERE c.root < e.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(root) AS root FROM c GROUP BY a) m ON m.a = d.doc_id
"""
