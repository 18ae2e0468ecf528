"""Nulls in every column, repeated rows, long texts, clashing names; the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quadlake.llm import bpe, chat, common, hnsw, jaccard, packing, suffixdedup, telephony, token_counts, toxicity, urlfilter

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, spans string, id long, class_id long, comp long, queue string, part long, row string, component string, __gone long, sig string"
LONG = " ".join(f"w{i}" for i in range(30_000))
NEARLY = " ".join(f"near{i}" for i in range(90))
COPY = " ".join(f"copy{i}" for i in range(120))
ROWS = [(1, COPY), (1, COPY), (2, COPY + " more"), (None, COPY), (None, COPY), (None, None), (None, ""), (3, None), (4, ""), (5, LONG), (6, LONG + " end"), (7, "short"), (8, "short"), ((1 << 60) + 1, "big id " + COPY[:300])]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None if k % 2 else "s", None, *[None] * 12) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


def shingled(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def removal(texts, width=200):
    """What is left of each text without runs of repeated strings of that many bytes, if they hold 51 words or 400 bytes."""
    raw, seen = [(t or "").encode() for t in texts], defaultdict(int)
    for t in raw:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] += 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        for run in re.finditer(b"\1+", bytes(gone)):
            if len(run[0]) < 400 and len(t[run.start() : run.end()].split()) < 51:
                gone[run.start() : run.end()] = bytes(len(run[0]))
        out.append(bytes(b for b, x in zip(t, gone, strict=True) if not x))
    return out


def test_every_operator_gives_each_row(odd):
    model = toxicity.train([])
    for df in (bpe.digests(odd, WORDS), token_counts.count_tokens(odd, BYTES), telephony.media_digests(odd), toxicity.score_documents(odd, model), jaccard.jaccard_join(odd), suffixdedup.substring_digests(odd)):
        assert sorted(str(r.doc_id) for r in df.collect()) == sorted(str(i) for i, _ in ROWS)
    lib = Tokenizer.from_file(WORDS)
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert sum(r.length for r in packing.pack(odd, WORDS).collect()) == total


def test_rows_without_id_take_part(odd):
    got = defaultdict(list)
    for r in jaccard.jaccard_join(odd).collect():
        got[r.doc_id].append(r)
    assert [r.n_links for r in got[1]] == [4, 4] and got[2][0].n_links == 4 and got[5][0].n_links == got[6][0].n_links == 1
    assert sorted((r.n_links, r.component_id, r.kept) for r in got[None] if r.n_links) == [(4, 1, False)] * 2
    left = sorted(removal([t for _, t in ROWS]))
    assert sorted((r.text or "").encode() for r in suffixdedup.without_repeats(odd).collect()) == left


def test_stages_keep_columns(odd, spark):
    for stage in (suffixdedup.without_repeats(odd), toxicity.without_toxic(odd, toxicity.train([])), corpus_pipeline.drop_near_duplicates(spark, odd, "")):
        assert stage.schema.names == odd.schema.names
    assert toxicity.without_toxic(odd, toxicity.train([])).count() == len(ROWS)
    none = odd.limit(0)
    assert suffixdedup.without_repeats(none).count() == corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0


def test_one_row_of_each_group_of_copies(spark):
    other = " ".join(f"other{i}" for i in range(120))
    rows = [(None, COPY), (9, COPY + " more"), (4, COPY), (4, COPY), (None, COPY), (None, other), (None, other), (None, other + " end"), (7, "short"), (None, ""), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in once if r.doc_id) == [(4, COPY), (7, "short"), (8, "")]
    assert sorted(str(r.text)[:5] for r in once if r.doc_id is None) == ["", "None", "other"]
    left = corpus_pipeline.drop_repeats(spark, spark.createDataFrame(once, docs.schema), "").collect()
    assert sorted(map(str, left)) == sorted(map(str, once))


def test_null_columns_elsewhere(spark):
    pages = spark.createDataFrame([(None, None, 1), (None, "http://a.org/x", 2), (1, "", 3)], "page_id long, url string, host int")
    assert sorted(r.verdict for r in urlfilter.judge_urls(pages).collect()) == ["allow"] * 3
    turns = spark.createDataFrame([(None, None, None, None, 1), (1, None, "assistant", "x", 2), (1, None, "assistant", "x", 2)], "conv_id long, turn long, role string, text string, formatted int")
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.conversation_digests(turns).collect()} == {None: (1, 0), 1: (2, 2)}
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1)], "vec_id long, embedding array<float>, v int")
    assert sorted((str(r.vec_id), r.component_id) for r in hnsw.near_duplicates(vectors).collect() if r.vec_id) == [("1", 1), ("2", 1), ("2", 1)]


def test_jaccard_like_brute_force(spark):
    rng, texts = np.random.default_rng(11), []
    for k in range(25):
        base = [f"t{k}x{i}" for i in range(int(rng.integers(30, 160)))]
        for _ in range(6):
            words = list(base)
            for i in rng.integers(0, len(words), rng.integers(0, 4)):
                words[i] = f"e{rng.integers(1000)}"
            texts.append(" ".join(words[int(rng.integers(0, 6)) :]))
    sets = [shingled(t) for t in texts]
    linked = [{j for j in range(len(sets)) if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(len(sets))]
    root = list(range(len(sets)))
    for _ in root:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(root))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (128, 2):
        got = {r.doc_id: r for r in jaccard.jaccard_join(frame, block=block).collect()}
        assert [got[i].n_links for i in range(len(sets))] == [len(x) for x in linked]
        assert [got[i].component_id for i in range(len(sets))] == root


def chain(k, words=60, step=4):
    return " ".join(f"c{i}" for i in range(k * step, k * step + words))


@pytest.mark.parametrize("unit", [256, 0, 1 << 40])
def test_jaccard_chain(spark, monkeypatch, unit):
    """A long chain of links, a dense group and a small one: band by band, as groups, and as the costs say."""
    monkeypatch.setattr(jaccard, "UNIT", unit)
    monkeypatch.setattr(jaccard, "PAIRS", 5000)
    texts = [chain(k) for k in range(500)] + [NEARLY + f" end{k}" for k in range(150)] + ["a b c d e f g h i j k l", "a b c d e f g h i j k l m", "A b c d  e f g h i j k l"]
    sets = [shingled(t) for t in texts]
    got = {r.doc_id: r for r in jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=64).collect()}
    for i in range(500):
        assert got[i].n_links == sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(max(0, i - 3), min(500, i + 4)) if j != i) and got[i].component_id == 0
    assert {(got[i].n_links, got[i].component_id) for i in range(500, 650)} == {(149, 500)}
    assert [(got[i].n_links, got[i].component_id) for i in range(650, 653)] == [(2, 650)] * 3


def test_long_words_of_equal_polynomials(spark):
    """Words of two letters in Thue-Morse order, and with the letters swapped, have equal polynomial hashes."""
    for n in (512, 1024, 2048):
        word = "".join("ab"[k.bit_count() % 2] for k in range(n))
        pair = [f"x{word}y", "x" + word.translate(str.maketrans("ab", "ba")) + "y"]
        frame = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
        lib = Tokenizer.from_file(WORDS)
        want = [hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for t in pair]
        assert [r.ids_sha256 for r in bpe.digests(frame.coalesce(1), WORDS).orderBy("doc_id").collect()] == want
        assert len({r.class_id for r in jaccard.jaccard_join(frame).collect()}) == 2


def test_word_keys():
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in rng.integers(1, 40, 5000)})
    data, size = b" ".join(words), np.array([len(w) for w in words])
    keys, checks = common.word_keys(data, np.cumsum(size + 1) - size - 1, size)
    assert len(set(keys.tolist())) == len(words)
    for k, w in enumerate(words[:50]):
        alone = common.word_keys(b"other " + w, np.array([6]), np.array([len(w)]))
        assert (alone[0][0], alone[1][0]) == (keys[k], checks[k])


def test_pipeline_like_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    some = lambda n: " ".join(rng.choice([f"v{i}" for i in range(300)], n))
    passage, short, quoted = some(150), some(51), some(46)
    assert 200 < len(quoted) < len(short) < 400
    texts = [some(int(rng.integers(40, 200))) for _ in range(160)]
    for i in range(0, 60, 2):
        texts[i] += " vilething"
    texts += [texts[101] + " tail", texts[101], f"{some(80)} {passage} {some(90)}", f"{some(70)} {passage} {some(60)}", f"{some(80)} {short} {some(70)}", f"{some(60)} {short}", f"{some(75)} {quoted} {some(70)}", f"{quoted} {some(65)}", None, ""]
    source = [f"s{i % 3}" for i in range(len(texts))]
    documents = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, source, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 60 and i % 2 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    alive = [i for i, t in enumerate(texts) if "vilething" not in (t or "")]
    sets = {i: shingled(texts[i]) for i in alive}
    keep = [i for i in alive if not any(j < i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in alive)]
    lib, lengths = Tokenizer.from_file(WORDS), defaultdict(int)
    packed = {i: np.array(lib.encode(t.decode(errors="ignore"), add_special_tokens=False).ids + [2], "<u4") for i, t in zip(keep, removal([texts[i] for i in keep]), strict=True)}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(packed[r.doc_id][r.start : r.start + r.length].tobytes()) and r.queue == source[r.doc_id]
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(x) for i, x in packed.items()}
    left = removal([texts[i] for i in keep])
    assert not any(short.encode() in t for t in left) and sum(quoted.encode() in t for t in left) == 2
