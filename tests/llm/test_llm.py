"""Operators against brute force and round trips, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swayflow.llm import bpe, chat, common, jaccard, lm, mixing, mtree, quality, shards, urls, warc

rnd = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(60)]


def prose(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def corpus():
    texts = [None, "", " \t", "one two", "one TWO", "Δ b c d e f", prose(5000)]
    for _ in range(12):
        base = prose(60).split()
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(VOCABULARY)
            texts.append(" ".join(copy))
    texts += [prose(30) for _ in range(30)] + [texts[8]] * 40
    return list(enumerate(texts))


DOCS = corpus()
TRAINS, HELD = (next(k for k in range(1000, 2000) if lm.held_out(k) == x) for x in (False, True))
TYPE = "doc_id long, text string, n_words string, size string, class string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in DOCS], TYPE).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], TYPE)


def test_words_are_told_apart_by_their_bytes():
    texts = [(t or "") for _, t in DOCS] + ["", " a\x0bB\x1cc  ", "É é"]
    words, index, n = common.words_in(pa.array([*texts, None]))
    assert [words[k] for k in index] == [w for t in texts for w in t.encode().lower().split()] and n.tolist() == [len(t.encode().split()) for t in texts] + [0]
    assert len(set(words)) == len(words) == len(set(common.word_hashes(words).tolist()))


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_collide_as_polynomials_do_not_link(spark):
    # Any polynomial hash modulo 2**64 gives a Thue-Morse word of 1024 letters and its complement the same number.
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.linked(df).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"]: r["n_known"] for r in lm.scored(df.where("doc_id < 3").withColumn("doc_id", F.when(F.col("doc_id") == 2, HELD).otherwise(TRAINS))).collect()} == {TRAINS: 2, HELD: 1}


def test_links_are_confirmed_word_by_word():
    base = prose(40).split()
    assert jaccard.similar("A b", "a B") and not jaccard.similar("a b", "a b c") and not jaccard.similar("", "") and not jaccard.similar("a", None)
    for cut in (1, 4, 8):
        x, y = " ".join(base), " ".join(base[cut:])
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.split(), y.split()))
        assert jaccard.similar(x, y) == (100 * len(a & b) >= 75 * len(a | b))


def test_quality_counts(docs, none):
    judged = quality.judged(docs.withColumns({"one": F.lit(7), "_words": F.lit(8), "_lines": F.lit(9)}))
    got = {r["doc_id"]: r for r in judged.collect()}
    assert {(r["one"], r["_words"], r["_lines"], r["size"], r["class"]) for r in got.values()} == {(7, 8, 9, "y", "z")}
    for i, t in DOCS:
        w = (t or "").split()
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        hit = {k + j for v in seen.values() if len(v) > 1 for k in v for j in range(5)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(w), len(hit), sum(map(len, w)))
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
    assert quality.judged(none).count() == 0


def test_jaccard_fragment_is_counted_in_parts():
    """What is kept of a fragment, against a dictionary; beside the fragment itself only a part of it is worked on at a time."""
    r = np.random.default_rng(3)
    shared, rows, want = r.integers(0, 1 << 63, 3000).astype("<u8"), [], {}
    for k in range(160):
        classes = np.array([(8 * k + j, 5) for j in range(8)], jaccard.CLASS)
        own = [np.unique(np.r_[r.choice(shared, 20), r.integers(0, 1 << 63, 1600).astype("<u8")]) for _ in classes]
        for c, x in zip(classes["a"].tolist(), own):
            for g in x.tolist():
                want.setdefault(g, set()).add(c)
        n = np.array([len(x) for x in own], "<i4").tobytes()
        rows += [jaccard._row(4, 0, "runs", classes=classes.tobytes(), sizes=n, counts=n, keys=np.concatenate(own).tobytes())] * (1 + (k == 7))
    hot = [next(g for g, c in want.items() if len(c) == 1), next(g for g, c in want.items() if len(c) > 1)]
    rows.append(jaccard._row(4, 0, "heavy", keys=np.array(hot, "<u8").tobytes()))
    passed = jaccard._row(-3, 2, "docs", docs=b"d" * 16, classes=b"c" * 16, sizes=b"s" * 4, ranks=b"\0")
    table = pa.Table.from_batches([jaccard._table([passed, *rows], jaccard._RUNS)])
    tracemalloc.start()
    out = jaccard._counted(table, 7).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * table.nbytes
    assert tuple(out[0].values()) == passed and all(x["frag"] == 4 for x in out[1:])
    got = {}
    for x in out[1:]:
        n, keys, ranks = np.frombuffer(x["counts"], "<i4"), np.frombuffer(x["keys"], "<u8"), np.frombuffer(x["ranks"], np.uint8)
        for c, g, rank in zip(np.repeat(np.frombuffer(x["classes"], jaccard.CLASS)["a"], n).tolist(), keys.tolist(), ranks.tolist()):
            assert c % 7 == x["at"] and (g, c) not in got
            got[g, c] = rank
    assert got == {(g, c): 255 if g in hot else min(254, len(cs)) for g, cs in want.items() if len(cs) > 1 or g in hot for c in cs}


def test_jaccard_join(docs, none):
    def grams(t):
        w = (t or "").split()
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in DOCS}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.linked(none).count() == 0


def test_bpe_equals_the_library(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    own = bpe.vocabulary(bpe.default_path())
    texts = [t or "" for _, t in DOCS] + ["a<|endoftext|>b", "İΣΑΣ ﬁ é \x1c 漢字 😀 ½ don't WE'LL", "ab" * 2000, "!" * 500]
    texts += ["".join(rnd.choice("etaoinshr lE'.<|>1é漢ßİ́\n") for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    for text in texts:
        ids = own.encode(text)
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and own.decode(ids).decode() == t.decode(want, skip_special_tokens=False)
    by_id = {r["doc_id"]: r for r in bpe.digests(docs.unionByName(docs.limit(3)), bpe.default_path()).collect()}
    for i, text in DOCS:
        want = t.encode(text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, want)), t.decode(want, skip_special_tokens=False))]
        assert [by_id[i]["n_tokens"], by_id[i]["ids_sha256"], by_id[i]["decoded_sha256"]] == [len(want), *digests]
    assert bpe.encoded(docs, bpe.default_path()).count() == len(DOCS) and bpe.digests(none, bpe.default_path()).count() == 0


def test_bpe_reads_its_file(tmp_path):
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        file = json.load(f)
    file["added_tokens"][0]["content"] = "<|other|>"
    own = tmp_path / "own.json"
    own.write_text(json.dumps(file))
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(str(own))
    for text in ("a <|other|> b", "a <|startoftext|> b", "<|endoftext|><|other|>"):
        assert bpe.vocabulary(str(own)).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"model": file["model"] | {"byte_fallback": True}}):
        own.write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            bpe.Bpe(str(own))


def test_chat_round_trip(spark, monkeypatch):
    hard = ["</s>[INST] ok [/INST]", "[\\INST] <s>[INST] ", "[ROLE x] a [/ROLE]", "", " </s>", "</s", "<\\/s>", "<<SYS>> <</SYS>>"]
    hard += ["".join(rnd.choice(["[", "/", "INST]", "</s>", "\\", " ", "<", "<SYS>>", "ROLE "]) for _ in range(8)) for _ in range(300)]
    for role in ("user", "assistant", "system", "tool] x", ""):
        for text in hard:
            assert [x[:2] for x in chat.parse(chat.render(role, text) + chat.render("user", "z"))] == [(role, text), ("user", "z")]
    rows = [(c, k, rnd.choice(["user", "assistant", None]), rnd.choice([*hard, None])) for c in (1, 2, None) for k in range(50)]
    for kind, piece in (("long", chat.PIECE), ("smallint", 7), ("string", 100)):
        monkeypatch.setattr(chat, "PIECE", piece)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("z")).withColumn("conv_id", F.col("conv_id").cast(kind))
        got = {r["conv_id"] if r["conv_id"] is None else int(r["conv_id"]): r for r in chat.read_back(df.repartition(7)).collect()}
        for c in (1, 2, None):
            mine = [(r or "", t or "") for x, _, r, t in rows if x == c]
            assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
            loss = "".join(t for r, t in mine if r == "assistant")
            assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (50, len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[c]["formatted_chars"] == sum(len(chat.render(*x)) for x in mine)
    assert chat.read_back(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_pieces_may_be_cut_anywhere():
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "[\\INST] " * 5), ("tool] x", ""), ("system", "<<SYS>>")]
    text = "".join(chat.render(*t) for t in turns)
    for size in range(1, 40):
        reader = chat.Reader()
        found = [x[:2] for at in range(0, len(text), size) for x in reader.feed(text[at : at + size])]
        assert found + [x[:2] for x in reader.end()] == turns
    for cut in range(1, len(text)):
        if text[:cut] not in {"".join(chat.render(*t) for t in turns[:k]) for k in range(5)}:
            with pytest.raises(chat.Broken):
                chat.parse(text[:cut])


def test_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/e", "block")]
    pages = ["http://a.EXAMPLE.com/en/1?x", "https://www.example.com/en/", "x://b.net/es", "no", None, "http://com/", "http://xcom/", "http://example.com/e#en/", "a://b.net?/es"] * 2

    def judged(url):
        if url is None or "://" not in url:
            return None
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p) for h, p, _ in rules if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        return max(fit)[2] if fit else None

    df = spark.createDataFrame([(k, u, "own", "x") for k, u in enumerate(pages)], "page_id long, url string, _url string, host string")
    more = [("h%d.example.com" % k, "/p%d/" % (k % 7), "block") for k in range(40)] + [("com", "/", "allow"), (None, "/", "block")]
    table = spark.createDataFrame(rules + more, "host string, path string, verdict string")
    for few in ((64, 200_000), (3, 200_000), (3, 3)):
        got = urls.judge(df, table, "url", "allow", *few)
        assert set(got.columns) == {"page_id", "url", "_url", "host", "path", "rule", "verdict"}
        rows = got.collect()
        assert {r["page_id"]: r["rule"] for r in rows} == {k: judged(u) for k, u in enumerate(pages)} and all(r["_url"] == "own" for r in rows) and len(rows) == len(pages)
    assert urls.judge(df.limit(0), table).count() == 0 and urls.judge(df, table.limit(0)).where("verdict = 'allow'").count() == len(pages)


class Backoff:
    """The model of lm, by dictionaries of n-grams and a formula that calls itself."""

    def __init__(self, rows):
        self.count, self.types = {}, set()
        for i, t in rows:
            if not lm.held_out(i):
                seen = ["<s>", *tokens_of(t)]
                self.types |= set(seen[1:])
                for k in range(1, lm.ORDER + 1):
                    for at in range(len(seen) - k + 1):
                        g = tuple(seen[at : at + k])
                        self.count[g] = self.count.get(g, 0) + 1
        self.n = sum(c for g, c in self.count.items() if len(g) == 1 and g != ("<s>",))

    def p(self, context, word):
        if not context:
            return (self.count.get((word,), 0) + 0.5) / (self.n + 0.5 * (len(self.types) + 1))
        prior = lm.PRIOR[len(context) + 1]
        return (self.count.get((*context, word), 0) + prior * self.p(context[1:], word)) / (self.count.get(context, 0) + prior)

    def score(self, text):
        seen = ["<s>", *tokens_of(text)]
        return sum(math.log10(self.p(tuple(seen[max(0, k - lm.ORDER + 1) : k]), seen[k])) for k in range(1, len(seen)))


def tokens_of(text):
    return [*(text or "").encode().lower().split(), "</s>"]


def test_lm(docs, none, monkeypatch):
    model = Backoff(DOCS)
    for block, size in ((lm.BLOCK_BYTES, lm.BUCKET_BYTES), (2000, 1000)):
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        monkeypatch.setattr(lm, "BUCKET_BYTES", size)
        got = {r["doc_id"]: r for r in lm.scored(docs).collect()}
        assert len(got) == len(DOCS)
        for i, text in DOCS:
            t, r = tokens_of(text), got[i]
            base = sum(math.log10(model.p((), w)) for w in t)
            assert (r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"]) == (len(t), sum((w,) in model.count for w in t), lm.held_out(i), model.n)
            assert abs(r["base_score"] - base) < 1e-9 * max(1, -base) and abs(r["score"] - model.score(text)) < 1e-9 * max(1, -r["score"])
    # A held-out copy of a text seen once is better predicted than by single words.
    held = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 20]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.scored(none).count() == 0


def test_lm_of_null_ids_repeated_rows_and_no_training_rows(spark):
    rows = [(None, "a b c"), (None, "a b c"), (TRAINS, "a b d"), (TRAINS, "a b d"), (HELD, None), (HELD, "a b c z"), (HELD, "a b c z")]
    model = Backoff(rows)
    out = [(r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out, key=repr) == sorted(((i, len(tokens_of(t)), round(model.score(t), 9)) for i, t in rows), key=repr)
    alone = lm.scored(spark.createDataFrame(rows[-1:], "doc_id long, text string")).collect()[0]
    assert (alone["train_tokens"], alone["n_known"]) == (0, 0) and alone["score"] == alone["base_score"] == 5 * math.log10(0.5 / 0.5)


def test_automaton_is_a_distribution():
    # Each context is followed by every word and by an unknown one in texts that are held out: the weights of the ways from its state sum to 1.
    rows = [(k, prose(12)) for k in range(40)]
    seen = sorted({w for i, t in rows if not lm.held_out(i) for w in t.split()})
    contexts = [" ".join(c) for i, t in rows[:12] for c in zip(t.split(), t.split()[1:], t.split()[2:])] + ["w0", "w1 nowhere", "nowhere", ""]
    probes = [f"{c} {w}".strip() for c in contexts for w in [*seen, "unknown", ""]]
    block, words = lm.Block.of([i for i, _ in rows] + [HELD] * len(probes), pa.array([t for _, t in rows] + probes, pa.large_string()), 4)
    local = np.bincount(block.flat[block.trains], minlength=len(words))
    block.named(np.arange(len(words)), local, np.ones(len(words), bool))
    for _ in range(lm.ORDER - 1):
        block.longer()
        block.take(lm.coded(block.local[-1], True))
    real = np.array([w != lm.START for w in words])
    model = lm.Automaton(block, int(local[real].sum()), int((local[real] > 0).sum()))
    model.walk()
    brute = Backoff(rows)
    for k, c in enumerate(contexts):
        mass = 0.0
        before = tokens_of(c)[:-1]
        for j in range(len(seen) + 2):
            doc = len(rows) + k * (len(seen) + 2) + j
            state = np.array([model.start])
            for t in range(len(before) + 1):
                state, weight = model.step(state, np.array([block.begin[doc] + 1 + t]))
            mass += 10 ** weight[0]
            want = brute.p(tuple(["<s>", *before][-(lm.ORDER - 1) :]), tokens_of(probes[doc - len(rows)])[len(before)])
            assert abs(10 ** weight[0] - want) < 1e-12
        assert abs(mass - 1) < 1e-9


def test_numbers_of_codes():
    for code in (np.array([5, 3, 5, 9]), np.array([1 << 62, 4, 1 << 62]), np.zeros(0, np.int64)):
        u, inv = lm.numbered(code)
        assert u.tolist() == sorted(set(code.tolist())) and u[inv].tolist() == code.tolist()


def test_warc(spark):
    big = "x" * 200
    rows = [(5, "http://a/", big), (3, None, big), (9, "u\nv", big), (1, "b", "short"), (2, "b", "short"), (4, None, None), (6, "c", "é\r\n\r\nWARC/1.1\r\n" * 20)]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[page]["record_type"], got[page]["refers_to"]) == (("revisit", 3) if page in (5, 9) else ("response", None))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_inflation_is_bounded_and_sees_cut_archives():
    import io

    body = b"a" * (5 * warc.CHUNK) + b"end"
    file = warc.gzipped(body) + warc.gzipped(b"") + warc.gzipped(b"next")
    pieces = list(warc.inflated(io.BytesIO(file)))
    assert b"".join(pieces) == body + b"next" and max(map(len, pieces)) <= warc.CHUNK
    assert list(warc.inflated(io.BytesIO(b""))) == []
    for cut in (1, 5, 9, 12):
        with pytest.raises(ValueError):
            list(warc.inflated(io.BytesIO(file[:-cut])))


def test_sharding(docs, none):
    rows = shards.sharded(docs, 6).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(x) for x in by.values()]
    assert len(rows) == len(DOCS) and len(by) == 6 and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    text = dict(DOCS)
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    groups = {}
    for r in rows:
        if text[r["doc_id"]]:
            groups.setdefault(text[r["doc_id"]], []).append(r["shard"])
    large = [g for g in groups.values() if len(g) > 30]
    assert all(max(map(g.count, g)) >= 12 for g in large)
    assert shards.sharded(none, 6).count() == 0


@pytest.mark.parametrize("sizes,single,most", [([1600] + [3] * 40, 3080, 0), ([100] * 12 + [7] * 40, 1000, 0), ([2] * 1000, 1, 7), ([3] * 400, 0, 23)])
def test_sharding_cuts_no_more_groups_than_sizes_ask(spark, sizes, single, most):
    # 15 shards of 83 rows can't be filled with pairs, so 7 of these must be cut; groups of three can't fill shards of 50, with no free row.
    rows = [(f"g{g}",) for g, size in enumerate(sizes) for _ in range(size)] + [(f"s{k}",) for k in range(single)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(k, t) for k, (t,) in enumerate(rows)], "doc_id long, text string").repartition(3)
    placed = shards.sharded(docs, 24).select("doc_id", "shard").join(docs, "doc_id").selectExpr("doc_id AS rid", "xxhash64(text) AS grp", "shard")
    by = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert len(by) == 24 and sum(by.values()) == len(rows) and max(by.values()) - min(by.values()) <= 1
    cut = shards.cuts(placed.select("rid", "grp"), placed.select("rid", "shard"), 24)
    assert cut.where("shards < least").count() == 0 and cut.where("shards > least").count() <= most


def test_sharding_of_null_and_repeated_ids(spark):
    rows = [(None, "a")] * 3 + [(1, "b")] * 5 + [(1, "c"), (2, None), (2, None), (3, "")]
    got = [tuple(r) for r in shards.sharded(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, shard string, rid string"), 4).select("doc_id", "text_crc32", "shard", "slot").collect()]
    assert sorted(map(repr, ((i, c) for i, c, _, _ in got))) == sorted(map(repr, ((i, zlib.crc32((t or "").encode())) for i, t in rows)))
    assert sorted(s for _, _, s, _ in got) == sorted(k % 4 for k in range(12)) and len({(s, p) for _, _, s, p in got}) == 12


def test_sharding_of_rows_in_several_groups(spark):
    members = [(k, g) for k in range(600) for g in (k // 6, 1000 + k // 12)]
    placed = shards.balanced(spark.range(1200).withColumnRenamed("id", "rid"), spark.createDataFrame(members, "rid long, grp long"), 6).collect()
    by = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r["rid"])
    where = {r["rid"]: r["shard"] for r in placed}
    assert sorted(map(len, by.values())) == [200] * 6 and len(where) == 1200
    assert sum(len({where[k] for k in range(g * 12, g * 12 + 12)}) > 1 for g in range(50)) <= 5


def exact_top(rows, k=10):
    """(query_id, rank, vec_id, score) by brute force, in Python integers; rows: (vec_id, whole numbers)."""
    out = []
    for n, (q, x) in enumerate(rows):
        if q is not None and q % 100 == 0:
            found = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), i) for m, (i, y) in enumerate(rows) if m != n and i is not None and len(x) == len(y))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(1200)] + [(5000, None), (5001, [1.0] * 7 + [math.nan]), (5002, [0.5] * 8), (5003, [0.5] * 8), (5100, [0.5, None] * 4), (None, [9.0] * 8)]
    # Repeated rows and ids, other lengths, many equal vectors, and numbers that doubles can't multiply exactly.
    vectors += [(100, vectors[100][1])] * 2 + [(200, [float(x) for x in rng.normal(size=8)]), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (400, [])]
    vectors += [(6000 + k, [0.25] * 8) for k in range(400)] + [(7000, [3.0e5 + 0.123] * 8), (7001, [-3.0e5] * 8)]
    df = mtree.quantised(spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, rank string")).cache()
    want = exact_top([(r["vec_id"], r["v"]) for r in df.collect() if r["vec_id"] is not None])
    for size in (mtree.CHUNK_BYTES, 5000):
        monkeypatch.setattr(mtree, "CHUNK_BYTES", size)
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df, df.where("vec_id % 100 = 0")).collect())
        assert got == want
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0
    large = mtree.quantised(spark.createDataFrame([(100, [3.0e6] * 8), (1, [3.0e6] * 8)], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="too large"):
        mtree.top_k(large, large.where("vec_id = 100")).collect()


@pytest.mark.parametrize(("noise", "most"), [(0.02, 0.25), (None, 1.3)])
def test_the_tree_leaves_out_products(noise, most):
    # Vectors in clusters need few of the products of brute force; those without any structure all, and the routing products besides.
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = rng.normal(size=(8000, 32)) if noise is None else centres[rng.integers(0, 40, 8000)] + rng.normal(0, noise, (8000, 32))
    x = np.floor(1024 * x)
    tree = mtree.Tree.of(np.arange(8000), x)
    assert tree.child.max() > 0 and (tree.children > 0).sum() > 3 and tree.count.max() <= mtree.PAGE and tree.count.sum() == 8000
    made = 0
    for q in x[::400]:
        found, _, n = tree.search(q, 11, -math.inf)
        made += n
        s = x @ q
        want = sorted(range(8000), key=lambda j: (-s[j], j))[:11]
        assert [i for i, _, _ in sorted(found, key=lambda f: (-f[1], f[0]))] == want
    assert made / (20 * 8000) < most


def test_mixing(spark, none):
    rows = [(k, prose(20) + (" awful" if k % 5 == 0 else "") + (" ###" if k % 7 == 0 else "")) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 != 0), int(k % 5 == 0)) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, labels).collect()
    tokens = sum(r["n_tokens"] for r in got)
    share = {d: sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) / tokens for d in mixing.DOMAINS}
    assert len(got) == 300 and all(r["rate"] >= 0 for r in got) and all(abs(share[d] - mixing.TARGETS[d]) < 1e-5 for d in share)
    assert all(r["residual"] < 1e-5 for r in got) and all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in got)
    right = sum((r["p_toxic"] > 0.5) == (r["doc_id"] % 5 == 0) for r in got if r["doc_id"] % 2)
    assert right > 0.95 * 150
    assert mixing.mixed(none, labels.limit(0)).count() == 0 and mixing.mixed(docs, labels.limit(0)).count() == 300


def test_rates_are_the_least_squares(spark):
    rng = np.random.default_rng(3)
    for goal in ({"clean": 0.98, "junk": 0.01, "toxic": 0.01}, {"clean": 0.1, "junk": 0.1, "toxic": 0.8}, {"clean": 1.0, "junk": 0.0, "toxic": 0.0}):
        p = rng.dirichlet([0.5, 0.3, 0.2], 60)
        n = rng.integers(0, 50, 60)
        rows = spark.createDataFrame([(int(k), *map(float, q)) for k, q in zip(n, p)], "n_tokens long, " + ", ".join(f"p_{d} double" for d in mixing.DOMAINS))
        rate, shares, _ = mixing.rates(rows, goal)
        r = np.array([x["r"] for x in rows.select(rate.alias("r")).collect()])
        a, b = (p * n[:, None] / n.sum()).T, np.array([goal[d] for d in mixing.DOMAINS])
        plain, step = np.ones(60), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(200_000):
            plain = np.maximum(0, plain - step * a.T @ (a @ plain - b))
        assert (r >= 0).all() and np.linalg.norm(a @ r - b) < np.linalg.norm(a @ plain - b) + 1e-5
        assert np.allclose([shares[d] for d in mixing.DOMAINS], a @ r)


def test_mixing_of_repeated_ids_extra_columns_and_targets_out_of_reach(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "a b", "z"), (1, "a b", "z")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.mixed(docs, labels).collect()
    assert sorted(repr((r["doc_id"], r["n_tokens"])) for r in rows) == sorted(["(None, 0)", "(1, 0)", "(1, 2)", "(1, 2)"])
    assert all(abs(r["p_junk"] - 1 / 3) < 1e-12 and r["residual"] > 0.3 for r in rows)


@pytest.mark.parametrize("junk", [6, 20])
def test_mixing_takes_rare_words_for_no_junk(spark, junk):
    r = random.Random(11)
    common, rare = [f"c{k}" for k in range(40)], [f"r{k}" for k in range(300)]
    # Short labelled rows, each with two of the rare words; long clean ones without a label hold many of them.
    short = [" ".join(r.choices(common, k=20) + r.sample(rare, 2)) for _ in range(1500)]
    bad = [" ".join(r.choices(common, k=15) + ["###"]) for _ in range(junk)]
    foul = [" ".join(r.choices(common, k=15) + ["awful"]) for _ in range(100)]
    long = [" ".join(r.choices(common, k=800) + r.sample(rare, 200)) for _ in range(60)]
    rows = list(enumerate(short + bad + foul + long))
    kinds = [(1, 0)] * len(short) + [(0, 0)] * junk + [(1, 1)] * len(foul)
    labels = spark.createDataFrame([(k, q, t) for k, (q, t) in enumerate(kinds)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    first = len(kinds)
    assert all(got[k]["p_clean"] > 0.5 for k in range(first, first + len(long)))
    assert all(got[k]["p_toxic"] > 0.5 for k in range(len(short) + junk, first))
    assert all(got[k]["p_junk"] > 0.5 if junk >= mixing.LEAST_LABELLED else got[k]["p_junk"] == 0 for k in range(len(short), len(short) + junk))


def written(spark, folder, rows, labels):
    """documents with an extra column, and labels."""
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("copies", F.lit(99)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    stop = ["the", "of", "and", "to", "in"]
    clean = {k: " ".join(rnd.choice(stop) if j % 3 == 0 else f"u{rnd.randrange(10**6)}" for j in range(60)) for k in range(80)}
    foul = {300 + k: " ".join(rnd.choice(stop) if j % 3 == 0 else f"u{rnd.randrange(10**6)}" for j in range(60)) + " awful" for k in range(30)}
    near = {100 + k: clean[k] + " end" for k in range(10)}
    rows = [*clean.items(), *foul.items(), *near.items(), (None, clean[3]), (4, clean[5]), (200, "### " * 50), (201, "a a"), (202, None), (203, ""), (7, clean[7])]
    written(spark, tmp_path, rows, [(k, 1, 0) for k in range(80)] + [(k, 1, 1) for k in foul] + [(None, 0, 1)])
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ruled = corpus_pipeline.quality_rules(spark, docs, d)
    want = [r for r in rows if r[1] and len(r[1].split()) >= 10 and "#" not in r[1]]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in ruled.collect()))) == sorted(map(repr, want))
    alone = corpus_pipeline.near_duplicates(spark, ruled, d)
    want = [*clean.items(), *foul.items()]
    # Of 4, 5 and the copy (4, text of 5) the last is the first row of the group of 5.
    want = [w for w in want if w[0] != 5] + [(4, clean[5])]
    assert sorted((r["doc_id"], r["text"]) for r in alone.collect()) == sorted(want) and alone.columns == list(corpus_pipeline.COLUMNS)
    places = {r["p"]: r["text"] for r in alone.select("text", F.xxhash64("text").alias("p")).collect()}
    copies = {(r["doc_id"], places[r["place"]]): r["copies"] for r in mixing.mixed(alone, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    mixed = corpus_pipeline.mixed_sources(spark, alone, d)
    assert sorted((r["doc_id"], r["text"]) for r in mixed.collect()) == sorted(w for w in want for _ in range(copies[w]))
    assert sum(copies[w] for w in want if w[0] >= 300) < 30 <= 80 <= sum(copies[w] for w in want if w[0] < 300)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, d).collect())

    def encoded(i, text):
        ids = library.encode(text, add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert got == sorted(encoded(*w) for w in want for _ in range(copies[w]))


def test_pipeline_of_no_documents_and_of_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    a, b = (" ".join(["the"] * 3 + [f"{x}{k}" for k in range(40)]) for x in "ab")
    docs = spark.createDataFrame([(3, a), (7, a), (7, b), (7, b), (None, None), (None, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))) == sorted(map(repr, [(3, a), (7, b), (None, None)]))
    written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
