"""BPE encoding and decoding: backtracking over Aho-Corasick matches, decoding by an offset table.

The vocabulary file is a parameter (its path must exist on every executor). Vocabulary, merges,
special tokens, the pattern of pieces and the end-of-word mark come from it; files of another make
(normalisers, splitting, byte fallback) are refused. A word is a string of symbols: one per byte,
the last one standing for the byte together with the end-of-word mark.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import load

BLANK = regex.compile(r"\p{White_Space}+")
#: str.split() also parts at these, which are no white space to the tokenizer.
ODD = regex.compile("[\x1c-\x1f]")
#: What a file must ask for, as the text is prepared by this module itself.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
#: Chunks and pieces a worker remembers at most; beyond it the memory starts anew.
MEMORY = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    moved = (b for b in range(256) if b not in plain)
    other = {b: chr(256 + k) for k, b in enumerate(moved)}
    return [chr(b) if b in plain else other[b] for b in range(256)]


def pattern_of(file: dict) -> str:
    """The pattern that finds the pieces of a text; raises for a file of another make."""

    def asks(part: dict | None, want: dict) -> bool:
        return part is not None and all(part.get(k, None) == v for k, v in want.items())

    normalizer, before = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [])
    fits = normalizer.get("normalizers") == NORMALIZERS and len(steps) == 2 and asks(steps[0], SPLIT) and asks(steps[1], BYTES) and asks(file["model"], MODEL)
    plain = all(not t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (fits and plain and file["model"].get("end_of_word_suffix")):
        raise ValueError("the tokenizer's file asks for steps that this module does not have")
    return steps[0]["pattern"]["Regex"]


class Bpe:
    """One vocabulary. Ranks: 0 to the number of single symbols for these, then one per merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.pieces = regex.compile(pattern_of(file))
        end = file["model"]["end_of_word_suffix"]
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")
        letters = byte_letters()
        self.inner = {b: chr(0x4000 + b) for b in range(256)}
        self.final = {b: chr(0x5000 + b) for b in range(256)}
        of = {c: b for b, c in enumerate(letters)}

        def symbols(token: str) -> str:
            if token.endswith(end) and len(token) > len(end):
                body = token[: -len(end)]
                return "".join(self.inner[of[c]] for c in body[:-1]) + self.final[of[body[-1]]]
            return "".join(self.inner[of[c]] for c in token)

        made = {a + b for a, b in pairs}
        single = [t for t in vocab if t not in made and t not in self.special]
        names = single + [a + b for a, b in pairs]
        rank = {t: k for k, t in enumerate(names)}
        self.ids = [vocab[t] for t in names]
        self.text = [symbols(t) for t in names]
        self.length = [len(s) for s in self.text]
        self.parts = [(k, k) for k in range(len(single))] + [(rank[a], rank[b]) for a, b in pairs]
        self.merged = {p: k for k, p in enumerate(self.parts) if k >= len(single)}
        self.n_single = len(single)
        self.compatible: dict[tuple[int, int], bool] = {}
        # A token that merges would never leave whole is no candidate.
        whole: dict[int, None] = {}
        for k, (a, b) in enumerate(self.parts):
            if k < self.n_single or (a in whole and b in whole and self.fits(a, b, below=k)):
                whole[k] = None
        by_text = {self.text[k]: k for k in whole}
        self.shorter = [-1] * len(names)
        for k in whole:
            s = self.text[k]
            self.shorter[k] = next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by_text), -1)
        self.matches = ahocorasick.Automaton()
        for s, k in by_text.items():
            self.matches.add_word(s, k)
        self.matches.make_automaton()
        # The offset table: token names by id, each followed by a space.
        top = max([*vocab.values(), *self.special.values()]) + 1
        named = [b""] * top
        for t, k in [*vocab.items(), *self.special.items()]:
            named[k] = t.encode() + b" "
        self.offsets = np.zeros(top + 1, np.int64)
        np.cumsum([len(x) for x in named], out=self.offsets[1:])
        self.names = np.frombuffer(b"".join(named), np.uint8)
        self.decimal = [str(k) for k in range(top)]
        self.known: dict[str, bytes] = {}

    def fits(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether merging leaves the tokens side by side: no merge across their border comes before those that made them.

        below: merges of this rank and later are not looked at (to test a token's own last merge).
        """
        key = (left, right)
        if below == 1 << 60 and key in self.compatible:
            return self.compatible[key]
        limit, a, b, out = below, left, right, True
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                out = False
                break
            # Undo the later of the two merges that touch the border; merges across it must come before that.
            if a >= self.n_single and (a > b or b < self.n_single):
                limit, a = min(limit, a), self.parts[a][1]
            elif b >= self.n_single:
                limit, b = min(limit, b + 1), self.parts[b][0]
            else:
                break
        if below == 1 << 60:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            self.compatible[key] = out
        return out

    def word(self, word: bytes) -> list[int]:
        """Token ids of one piece, in time linear in its length."""
        s = word[:-1].decode("latin-1").translate(self.inner) + self.final[word[-1]]
        n = len(s)
        longest = [-1] * (n + 1)
        for end, k in self.matches.iter(s):
            longest[end + 1 - self.length[k]] = k  # matches at a place come by rising end
        dead = bytearray(n + 1)
        out: list[int] = []
        length, shorter, known, fits = self.length, self.shorter, self.compatible, self.fits
        at, k, before = 0, longest[0], -1
        while at < n:
            while k >= 0:
                if not dead[at + length[k]]:
                    if before < 0:
                        break
                    ok = known.get((before, k))
                    if ok or (ok is None and fits(before, k)):
                        break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at += length[k]
                before, k = k, longest[at]
            else:
                dead[at] = 1
                k = out.pop()
                at -= length[k]
                before = out[-1] if out else -1
                k = shorter[k]
        return [self.ids[k] for k in out]

    def piece(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = array("i", self.word(piece.encode())).tobytes()
            if len(piece) <= 64:
                self.known[piece] = got
        return got

    def chunk(self, chunk: str) -> bytes:
        """Ids of text without white space; remembered as its pieces are."""
        if len(self.known) >= MEMORY:
            self.known.clear()
        pieces = self.pieces.findall(chunk)
        if len(pieces) == 1:
            return self.piece(pieces[0])
        got = b"".join(map(self.piece, pieces))
        if len(chunk) <= 64:
            self.known[chunk] = got
        return got

    def plain(self, text: str) -> bytes:
        """Ids of text without special tokens, as int32 bytes."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        known, chunk = self.known.get, self.chunk
        chunks = BLANK.split(text) if ODD.search(text) else text.split()
        return b"".join([known(c) or chunk(c) for c in chunks])

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not any(t in text for t in self.special):
            return np.frombuffer(self.plain(text), np.int32)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.plain(text[at : m.start()]), np.int32(self.special[m.group()]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self.plain(text[at:])]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Token names joined by spaces, copied from the offset table; UTF-8."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        first = np.cumsum(size) - size
        return self.names[np.repeat(start - first, size) + np.arange(int(size.sum()))].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int) and decoded text of every row; null text is empty.

    One narrow pass: no shuffle, repeated rows and ties are rows like others, an empty table
    gives none. A text of any length is held whole, one at a time.
    """
    docs = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            back = [bpe.decode(x).decode() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest columns of `encoded`, made in the same pass so that ids and texts need not leave the worker."""
    docs = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        sha = hashlib.sha256
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for k in range(batch.num_rows):
                ids = bpe.encode(batch.column(1)[k].as_py())
                n.append(len(ids))
                of_ids.append(sha(" ".join(map(bpe.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"), default_path())
