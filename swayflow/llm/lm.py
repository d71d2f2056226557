"""Language-model scoring with a weighted backoff automaton.

An n-gram model of ORDER words over an add-half unigram base is learned from all training
texts. A word after a context has the weight (count + PRIOR * weight after the context without
its first word) / (count of the context + PRIOR). The states are all contexts of up to ORDER - 1
words that training holds, the root being the empty one; arcs are all n-grams that training
holds, seen once or often; a state's failure arc leads to the context without its first word and
carries PRIOR / (count + PRIOR). One pass from left to right carries the state, takes failure
arcs until the word has an arc, and adds up log-probabilities. A text's walk is cut into lanes
that move in step; a lane reads the ORDER - 1 words before its own, which fix its state.

Counts are gathered order by order. Rows are packed into blocks of about BLOCK_BYTES of text,
written once to the shared folder. A block sends its distinct n-grams, as global word numbers, to
reducers by a hash of the whole n-gram, so that a frequent one costs a reducer one entry per
block, and gets back their counts. An n-gram whose first or last words (all but one) no other
block holds, or no training text, has the count that the block itself knows, and is not sent. Words
are told apart by their bytes, n-grams by all their word numbers: nothing rests on a hash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load, mixed, text_bytes, words_in

ORDER = 4
#: Weight of the shorter context, in counts, by the length of the n-gram; the best of a few tried on held-out text.
PRIOR = {2: 1000.0, 3: 30.0, 4: 1.0}
#: Text of a block and of a reducer's share, tokens of a lane.
BLOCK_BYTES, BUCKET_BYTES, LANE = 4 << 20, 8 << 20, 256
FOLDS, HELD_OUT = 5, 1
#: The words before and after a text; white space, so no words of a text.
START, END = b"\t", b"\n"


def held_out(doc_id: int | None) -> bool:
    """Whether a document is held out; one without an id is for training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs, by byte planes, compressed."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << 8 * w)
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return planes.reshape(data[0], -1).T.copy().view(f"<u{data[0]}").ravel().astype(np.int64)


def coded(total: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """A count and whether only one block holds the n-gram, as one number."""
    return 2 * total + alone


def numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, rising, and the number of each: np.unique, by one sort of codes with their places where both fit into 64 bits."""
    n = len(code)
    bits = max(n - 1, 1).bit_length()
    if not n or int(code.max()).bit_length() + bits > 63:
        return np.unique(code, return_inverse=True)
    both = np.sort((code << bits) | np.arange(n))
    at, code = both & ((1 << bits) - 1), both >> bits
    new = np.r_[True, code[1:] != code[:-1]]
    number = np.empty(n, np.int64)
    number[at] = np.cumsum(new) - 1
    return code[new], number


def dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket (else as it is), and where each bucket begins."""
    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    return np.argsort(bucket, kind="stable"), np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]


class Folder:
    """Files of the blocks in the shared folder. A name stands for its contents, so a repeated task writes the same file again."""

    def __init__(self, uri: str):
        self.fs, self.base = pafs.FileSystem.from_uri(uri)

    def put(self, name: str, data: bytes) -> None:
        path, part = f"{self.base}/{name}", f"{self.base}/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part, compression=None) as f:
            f.write(data)
        try:
            self.fs.move(part, path)
        except OSError:
            if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
                raise
            self.fs.delete_file(part)

    def get(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{name}", compression=None) as f:
            return f.read()


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


class Block:
    """The tokens of some documents and their distinct n-grams.

    flat: the word of every token, each text between START and END. An n-gram of k words is known
    by its number among those of the block, in the order of its words; first, last: the n-grams
    without its last and its first word; tail: its last word; local, total: its count in the
    block's training texts and in all; alone: whether no other block's texts hold it.
    """

    def __init__(self, ids: list[int | None], size: np.ndarray, flat: np.ndarray, bounds: np.ndarray):
        self.ids, self.size, self.flat, self.bounds = ids, size, flat, bounds
        self.held = np.array([held_out(d) for d in ids], bool)
        self.begin = np.cumsum(size + 1) - (size + 1)
        self.place = np.arange(len(flat)) - np.repeat(self.begin, size + 1)
        self.trains = np.repeat(~self.held, size + 1)

    @staticmethod
    def of(ids: list[int | None], texts: pa.Array, buckets: int) -> tuple[Block, list[bytes]]:
        """A block of texts, and its words, which are ordered by bucket."""
        words, index, counts = words_in(texts)
        words += [START, END]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order, bounds = dealt(bucket, buckets)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        to = np.cumsum(counts)
        flat = np.insert(index, np.stack([to - counts, to], 1).ravel(), np.tile([len(words) - 2, len(words) - 1], len(counts)))
        return Block(ids, counts + 1, rank[flat], bounds), [words[k] for k in order]

    def stored(self) -> bytes:
        ids = np.array([0 if d is None else d for d in self.ids], "<i8").tobytes()
        return _joined([zlib.compress(ids), bytes(d is None for d in self.ids), packed(self.size), packed(self.flat), packed(self.bounds)])

    @staticmethod
    def read(data: bytes) -> Block:
        ids, null, size, flat, bounds = _split(data)
        known = [None if n else d for d, n in zip(np.frombuffer(zlib.decompress(ids), "<i8").tolist(), null)]
        return Block(known, unpacked(size), unpacked(flat), unpacked(bounds))

    def named(self, numbers: np.ndarray, total: np.ndarray, alone: np.ndarray) -> None:
        """Takes the words' global numbers and counts; from here on words are in the order of their global numbers."""
        order = np.argsort(numbers)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.word = rank[self.flat]
        self.start, self.end = int(self.word[0]), int(self.word[self.size[0]])
        self.words = len(order)
        self.number = [np.zeros(len(self.flat), np.int64), self.word]
        self.numbers = numbers[order]
        self.first, self.last = [None, np.zeros(self.words, np.int64)], [None, np.zeros(self.words, np.int64)]
        self.tail = [None, np.arange(self.words)]
        self.local = [None, np.bincount(self.word[self.trains], minlength=self.words)]
        self.total, self.alone = [None, total[order]], [None, alone[order]]

    def longer(self) -> None:
        """Numbers the n-grams of one word more than before."""
        k = len(self.number)
        at = np.flatnonzero(self.place >= k - 1)
        shorter = self.number[k - 1]
        code, here = numbered(shorter[at - 1] * self.words + self.word[at])
        number = np.full(len(self.flat), -1)
        number[at] = here
        last = np.empty(len(code), np.int64)
        last[here] = shorter[at]
        first = code // self.words
        self.number.append(number)
        self.first.append(first)
        self.last.append(last)
        self.tail.append(code % self.words)
        self.local.append(np.bincount(here[self.trains[at]], minlength=len(code)))

    def names(self, grams: np.ndarray) -> list[np.ndarray]:
        """The global numbers of the words of some of the longest n-grams, a column for each place."""
        out = []
        for k in range(len(self.number) - 1, 0, -1):
            out.append(self.numbers[self.tail[k][grams]])
            grams = self.first[k][grams]
        return out[::-1]

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The longest n-grams of which other blocks may know more, by bucket and then by their words; and where each bucket begins."""
        k = len(self.number) - 1
        own = self.alone[k - 1] | (self.total[k - 1] == 0)
        open_ = np.flatnonzero(~(own[self.first[k]] | own[self.last[k]]))
        h = np.zeros(len(open_), np.uint64)
        for c in self.names(open_):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
        order, bounds = dealt(mixed(h) % np.uint64(buckets), buckets)
        return open_[order], bounds

    def told(self, replies: dict[int, bytes], buckets: int) -> None:
        """Takes the counts of the n-grams it asked for."""
        grams, bounds = self.asked(buckets)
        code = coded(self.local[-1], np.ones(len(self.local[-1]), bool))
        for b in np.flatnonzero(np.diff(bounds)):
            code[grams[bounds[b] : bounds[b + 1]]] = unpacked(_reply(replies, int(b)))
        self.take(code)

    def take(self, code: np.ndarray) -> None:
        self.total.append(code >> 1)
        self.alone.append((code & 1).astype(bool))


def _reply(replies: dict[int, bytes], bucket: int) -> bytes:
    if bucket not in replies:
        raise ValueError("a block's answers are incomplete: its rows came in another order when they were read again")
    return replies[bucket]


ASK = "bucket int, block string, grams binary, counts binary"
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("grams", pa.binary()), ("counts", pa.binary())])
REPLY = "block string, bucket int, counts binary, numbers binary, tokens long, types long"
_REPLY = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary()), ("numbers", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _words_sent(batches: Iterator[pa.RecordBatch], folder: str, buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Packs rows into blocks, writes these, and sends their words with their training counts."""
    home, task, made = Folder(folder), TaskContext.get().partitionId(), 0

    def sent(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal made
        ids = [d for p in parts for d in p.column(0).to_pylist()]
        texts = pa.concat_arrays([p.column(1).cast(pa.large_string()) for p in parts])
        block, words = Block.of(ids, texts, buckets)
        data = block.stored()
        name = f"{task:06d}-{made:06d}-{hashlib.blake2b(data, digest_size=8).hexdigest()}"
        made += 1
        home.put(f"{name}.0", data)
        local = np.bincount(block.flat[block.trains], minlength=len(words))
        rows = []
        for b in np.flatnonzero(np.diff(block.bounds)):
            of = slice(block.bounds[b], block.bounds[b + 1])
            rows.append((int(b), name, zstandard.ZstdCompressor(level=1).compress(b" ".join(words[of])), packed(local[of])))
        return _rows(rows, _ASK).to_batches()[0]

    waiting, size = [], 0
    for batch in batches:
        long_ = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            before = int(long_[at - 1]) if at else 0
            to = min(int(np.searchsorted(long_, before + block_bytes - size)) + 1, batch.num_rows)
            waiting.append(batch.slice(at, to - at))
            size += int(long_[to - 1]) - before
            at = to
            if size >= block_bytes:
                yield sent(waiting)
                waiting, size = [], 0
    if waiting:
        yield sent(waiting)


def _words_counted(table: pa.Table, buckets: int) -> pa.Table:
    """Words of one bucket: their counts over all blocks, and global numbers that are small for frequent words."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    bucket = rows[0]["bucket"]
    lists = [zstandard.ZstdDecompressor().decompress(r["grams"]).split(b" ") for r in rows]
    distinct = pa.concat_arrays([pa.array(x, pa.large_binary()) for x in lists]).dictionary_encode()
    index, words = distinct.indices.to_numpy().astype(np.int64), distinct.dictionary.to_pylist()
    total = np.bincount(index, weights=np.concatenate([unpacked(r["counts"]) for r in rows]), minlength=len(words)).astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(words))  # ties: the order of the blocks, which is fixed
    code = coded(total, np.bincount(index, minlength=len(words)) == 1)
    real = np.array([w != START for w in words])
    out, at = [], 0
    for k, (r, x) in enumerate(zip(rows, lists)):
        i = index[at : at + len(x)]
        at += len(x)
        out.append((r["block"], bucket, packed(code[i]), packed(rank[i] * buckets + bucket), int(total[real].sum()) if not k else 0, int((total[real] > 0).sum()) if not k else 0))
    return _rows(out, _REPLY)


def _grams_counted(table: pa.Table) -> pa.Table:
    """n-grams of one bucket: their counts over all blocks."""
    rows = table.to_pylist()
    parts = []
    for r in rows:
        first, *more = map(unpacked, _split(r["grams"]))
        parts.append([np.cumsum(first), *more])
    columns = [np.concatenate(c) for c in zip(*parts)]
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    count = np.concatenate([unpacked(r["counts"]) for r in rows])[by]
    begin = np.flatnonzero(new)
    code = np.empty(len(by), np.int64)
    code[by] = coded(np.add.reduceat(count, begin), np.diff(np.r_[begin, len(by)]) == 1)[np.cumsum(new) - 1]
    out, at = [], 0
    for r, p in zip(rows, parts):
        out.append((r["block"], r["bucket"], packed(code[at : at + len(p[0])]), None, 0, 0))
        at += len(p[0])
    return _rows(out, _REPLY)


def _known(table: pa.Table, folder: Folder, order: int, buckets: int) -> Block:
    """A block with the counts of its n-grams of up to `order` words, the longest from the replies; writes these for the next orders."""
    name = table.column("block")[0].as_py()
    replies = {r["bucket"]: r for r in table.to_pylist()}
    block = Block.read(folder.get(f"{name}.0"))
    if order == 1:
        parts = [_reply(replies, int(b)) for b in np.flatnonzero(np.diff(block.bounds))]
        numbers, code = (np.concatenate([unpacked(p[c]) for p in parts]) for c in ("numbers", "counts"))
        folder.put(f"{name}.1", _joined([packed(numbers), packed(code)]))
    else:
        numbers, code = map(unpacked, _split(folder.get(f"{name}.1")))
    block.named(numbers, code >> 1, (code & 1).astype(bool))
    for k in range(2, order + 1):
        block.longer()
        if k < order:
            block.take(unpacked(folder.get(f"{name}.{k}")))
        else:
            block.told({b: r["counts"] for b, r in replies.items()}, buckets)
            if k < ORDER:
                folder.put(f"{name}.{k}", packed(coded(block.total[k], block.alone[k])))
    return block


def _grams_sent(table: pa.Table, folder: str, order: int, buckets: int) -> pa.Table:
    """A block's n-grams of `order` words that others may know, after it has learned the shorter ones."""
    block = _known(table, Folder(folder), order - 1, buckets)
    block.longer()
    grams, bounds = block.asked(buckets)
    name, rows = table.column("block")[0].as_py(), []
    for b in np.flatnonzero(np.diff(bounds)):
        g = grams[bounds[b] : bounds[b + 1]]
        first, *more = block.names(g)
        rows.append((int(b), name, _joined([packed(np.diff(first, prepend=0)), *map(packed, more)]), packed(block.local[order][g])))
    # A block that has nothing to ask still gets a reply, so that it is not lost.
    rows.append((-1 - zlib.crc32(name.encode()) % buckets, name, _joined([packed(np.zeros(1, np.int64))] * order), packed(np.zeros(1, np.int64))))
    return _rows(rows, _ASK)


class Automaton:
    """States, arcs and failure arcs of the model, as far as a block can reach them; weights are log10 probabilities.

    State 0 is the root; after it come the n-grams of up to ORDER - 1 words. arc: of each n-gram, as
    the step from its context by its last word, the number of its arc, -1 if the model has none;
    every word has an arc from the root.
    """

    def __init__(self, block: Block, n: int, v: int):
        self.block = block
        sizes = [1] + [len(block.total[k]) for k in range(1, ORDER + 1)]
        at = np.cumsum(sizes) - sizes  # the first state of each order
        self.grams = at - 1  # where the n-grams of each order begin in `arc`
        self.order = np.repeat(np.arange(ORDER), sizes[:ORDER])
        p = (block.total[1] + 0.5) / (n + 0.5 * (v + 1))
        self.base = np.log10(p)
        self.failure, self.shorter = np.zeros(at[ORDER]), np.zeros(at[ORDER], np.int64)
        arc, weights, to = [], [], []
        for k in range(1, ORDER + 1):
            total, first, last = block.total[k], block.first[k], block.last[k]
            if k > 1:
                p = (total + PRIOR[k] * p[last]) / (block.total[k - 1][first] + PRIOR[k])
            seen = total > 0
            arc.append(seen | (k == 1))
            weights.append(np.log10(p))
            to.append(np.where(seen, at[k] + np.arange(len(total)), 0) if k < ORDER else at[k - 1] + last)
            if k < ORDER:
                states = slice(at[k], at[k] + len(total))
                self.failure[states] = np.log10(PRIOR[k + 1] / (total + PRIOR[k + 1]))
                self.shorter[states] = at[k - 1] + last
        arc = np.concatenate(arc)
        self.arc = np.where(arc, np.cumsum(arc) - 1, -1)
        self.weights, self.to = (np.concatenate(x)[arc] for x in (weights, to))
        self.start = int(at[1] + block.start) if block.total[1][block.start] else 0

    def step(self, state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each lane, which reads the word at `place`, and the weight of the way there: failure arcs until the word has an arc, then that arc.

        A state of k words stands for the k words before the place, so its arc is that of the n-gram of k + 1 words which ends there.
        """
        state, weight = state.copy(), np.zeros(len(state))
        arc, left = np.empty(len(state), np.int64), np.arange(len(state))
        while len(left):
            k = self.order[state[left]] + 1
            found = self.arc[self.grams[k] + self.numbers[k, place[left]]]
            hit = found >= 0
            arc[left[hit]] = found[hit]
            left = left[~hit]
            weight[left] += self.failure[state[left]]
            state[left] = self.shorter[state[left]]
        return self.to[arc], weight + self.weights[arc]

    def walk(self) -> np.ndarray:
        """The log-probability of each text."""
        block = self.block
        self.numbers = np.stack(block.number)
        lanes = -(-block.size // LANE)
        doc = np.repeat(np.arange(len(block.size)), lanes)
        own = (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        to = np.minimum(own + LANE, block.size[doc])
        at = np.maximum(own - (ORDER - 1), 0)
        by = np.argsort(at - to, kind="stable")  # longest first
        doc, own, to, at = doc[by], own[by], to[by], at[by]
        state, total = np.where(at == 0, self.start, 0), np.zeros(len(doc))
        first, length = block.begin[doc] + 1, to - at
        for j in range(int(length[0])):
            m = int(np.searchsorted(-length, -j, side="left"))  # lanes longer than j
            state[:m], weight = self.step(state[:m], first[:m] + at[:m] + j)
            total[:m] += np.where(at[:m] + j >= own[:m], weight, 0.0)
        return np.bincount(doc, weights=total, minlength=len(block.size))


def _round(replies: DataFrame, folder: str, order: int, buckets: int, tasks: int) -> DataFrame:
    """From the replies of one order to those of the next. tasks: of blocks, as their work does not show in the size of the replies."""
    asked = replies.repartition(tasks, "block").groupBy("block").applyInArrow(lambda t: _grams_sent(t, folder, order, buckets), ASK)
    return asked.groupBy("bucket").applyInArrow(lambda t: _grams_counted(t), REPLY)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(table: pa.Table, folder: str, buckets: int, n: int, v: int) -> pa.Table:
    b = _known(table, Folder(folder), ORDER, buckets)
    model = Automaton(b, n, v)
    tokens = b.word[b.place > 0]
    first = np.cumsum(b.size) - b.size
    base, known = (np.add.reduceat(x[tokens], first) for x in (model.base, (b.total[1] > 0).astype(np.int64)))
    cols = [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.size), pa.array(known), pa.array(np.full(len(b.ids), n, np.int64)), pa.array(base), pa.array(model.walk())]
    return pa.Table.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by the model of the training rows.

    Null text is empty: its one token is the end. Rows without an id train. Repeated rows count
    and are scored as often as they stand; there are no ties to break; without training rows every
    token has the base's add-half probability. An empty table gives none; other columns are not
    looked at. Rows are packed as they come, so no id or text is a hot key; a text is held whole,
    in a block of its own if it is longer than a block. The blocks' files need a shared folder that
    pyarrow can open.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession, "lm")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = scratch.save("docs", docs)  # a repeated task must see the same rows in the same order, as scans do
    least = min(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = text_bytes(docs, "text")
    buckets, tasks = max(least, size // BUCKET_BYTES + 1), max(least, size // (8 * BLOCK_BYTES) + 1)
    folder = f"{scratch.base}/blocks"
    Folder(folder).fs.create_dir(Folder(folder).base, recursive=True)
    block_bytes = BLOCK_BYTES
    asked = docs.mapInArrow(lambda x: _words_sent(x, folder, buckets, block_bytes), ASK)
    replies = scratch.save("words", asked.groupBy("bucket").applyInArrow(lambda t: _words_counted(t, buckets), REPLY))
    totals = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    n, v = totals["n"], totals["v"]
    for k in range(2, ORDER + 1):
        replies = scratch.save(f"grams-{k}", _round(replies, folder, k, buckets, tasks))
    return replies.repartition(tasks, "block").groupBy("block").applyInArrow(lambda t: _scored(t, folder, buckets, n, v), SCORES)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(load(spark, sf_dir, "documents"))
