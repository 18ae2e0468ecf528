"""The corpus operators against the libraries, brute force and round trips, with odd rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quadlake.llm import bpe, chat, common, hnsw, jaccard, packing, suffixdedup, telephony, token_counts, toxicity, urlfilter
from quadlake.llm.components import connected

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = " ".join(f"shared{i} passage{i * 7}" for i in range(60))
NEAR = " ".join(f"word{i}" for i in range(200))
TEXTS = [None, "", " ", "a", "Hello  world's <|endoftext|>end\n\n x", "Ünïcödé Σ ΑΣ é ’quotes’ 中文", "x" * 3000, "be " * 900, f"one {PASSAGE} two", f"three {PASSAGE} four", NEAR, NEAR + " tail", NEAR, "same " * 3, "same " * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i else None, 0, 9) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long")


def by_id(df, name="doc_id"):
    return {r[name]: r for r in df.collect()}


def test_bpe_like_library(docs):
    lib = Tokenizer.from_file(WORDS)
    for i, r in by_id(bpe.digests(docs, WORDS)).items():
        ids = lib.encode(TEXTS[i] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts_like_library(docs):
    lib = Tokenizer.from_file(BYTES)
    for i, r in by_id(token_counts.count_tokens(docs, BYTES)).items():
        assert r.n_tokens == len(lib.encode(TEXTS[i] or "", add_special_tokens=False).ids)


def test_telephony_round_trip(docs):
    for i, r in by_id(telephony.media_digests(docs)).items():
        raw = (TEXTS[i] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.payload_bytes, r.tail_crc32, r.payload_sha256) == (len(payload), zlib.crc32(payload[-16:]), hashlib.sha256(payload).hexdigest())
        assert (r.media_bytes, r.media_sha256) == (len(telephony.to_wave(payload, "mulaw")), hashlib.sha256(telephony.to_wave(payload, "mulaw")).hexdigest())
        blocks = [telephony.UNIT * k for k in range(len(payload) // telephony.UNIT)]
        adpcm = b"".join(np.array(scalar_adpcm(payload[a : a + telephony.UNIT]), "<i2").tobytes() for a in blocks)
        parts = dict(x.split("=") for x in r.feature.split(";"))
        assert int(parts["adpcm"], 16) == zlib.crc32(adpcm)
        linear = [scalar_mulaw(b) for b in payload]
        assert parts["mulaw"] == f"{max(map(abs, linear))},{sum(map(abs, linear)) // len(linear)},{sum((a < 0) != (b < 0) for a, b in zip(linear, linear[1:]))}"
        wide = [y for a, b in zip(linear, linear[1:] + linear[-1:]) for y in (a, (a + b) >> 1)]
        assert int(parts["pcm16k"], 16) == zlib.crc32(telephony.to_wave(np.array(wide, "<i2").tobytes(), "pcm", 16000))


def scalar_mulaw(b):
    """One mu-law byte by its definition: sign, exponent and mantissa, all inverted."""
    b = ~b & 255
    size = ((2 * (b & 15) + 33) << (b >> 4 & 7)) - 33 << 2
    return -size if b & 128 else size


def scalar_adpcm(block):
    """One block, one code after the other."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = step // 8 + step * (code >> 2 & 1) + step // 2 * (code >> 1 & 1) + step // 4 * (code & 1)
            value = max(-32768, min(32767, value + (-change if code & 8 else change)))
            index = max(0, min(88, index + int(telephony.MOVES[code])))
            out.append(value)
    return out


def test_media_columns_and_decoding(spark, docs):
    rows = by_id(telephony.store_texts(docs))
    media = [(i, bytes(r.media)) for i, r in rows.items()]
    sound = np.arange(0, 1200, dtype=np.int16).tobytes()
    odd = [(100, None), (101, b""), (102, b"RIFF"), (103, telephony.to_wave(sound, "pcm")), (104, telephony.to_wave(bytes(range(192)) * 2, "adpcm")), (105, telephony.to_wave(b"", "alaw")), (106, telephony.to_wave(b"ab", "mulaw").replace(b"\x07\x00\x01", b"\x63\x00\x01", 1))]
    got = {r.id: r.pcm for r in telephony.decode_audio(spark.createDataFrame(media + odd, "id long, media binary")).collect()}
    assert all(got[i] == r.pcm for i, r in rows.items()) and [got[i] is None for i in range(100, 107)] == [True, True, True, False, False, False, True]
    kind, rate, pcm = telephony.from_wave(bytes(got[103]))
    assert (kind, rate) == ("pcm", 16000) and np.array_equal(np.frombuffer(pcm, np.int16)[::2], np.frombuffer(sound, np.int16))
    assert np.frombuffer(telephony.from_wave(bytes(got[104]))[2], np.int16)[::2].tolist() == 2 * scalar_adpcm(bytes(range(192)))


def test_encoded_columns(docs):
    lib = Tokenizer.from_file(WORDS)
    for i, r in by_id(bpe.encode_documents(docs, WORDS)).items():
        ids = lib.encode(TEXTS[i] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and bytes(r.decoded).decode() == lib.decode(ids, skip_special_tokens=False)


def test_companding_tables():
    assert telephony.MULAW[0xFF] == 0 and telephony.MULAW[0] == -32124 and telephony.ALAW[0xD5] == 8 and telephony.ALAW[0x2A] == -32256


def test_packing(docs):
    lib = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs, WORDS, length=64, window_sequences=2).collect()
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(filled) == list(range(len(filled)))
    for k, parts in filled.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or k == max(filled)


@pytest.mark.parametrize("weights", [[1, 1, 1], [5, 1, 0], [0, 0, 0], [1000, 1, 1], [1000, 37, 5]])
def test_schedule_uses_every_token(weights):
    totals = [1000, 37, 5]
    places = packing.Places(packing.schedule(totals, weights, 16, 4), 16, 16)
    spots = [(sequence, offset + k) for q, n in enumerate(totals) for _, size, sequence, offset in places.of(q, 0, n) for k in range(size)]
    assert sorted(spots) == [divmod(i, 16) for i in range(sum(totals))]


def test_many_small_queues():
    rng = np.random.default_rng(1)
    for _ in range(30):
        totals = [int(x) for x in rng.integers(0, 400, rng.integers(1, 12))]
        places = packing.Places(packing.schedule(totals, totals, 32, 8), 32, 16)
        spots = [(sequence, offset + k) for q, n in enumerate(totals) for _, size, sequence, offset in places.of(q, 0, n) for k in range(size)]
        assert sorted(spots) == [divmod(i, 16) for i in range(sum(totals))]


def test_virtual_places():
    rng = np.random.default_rng(4)
    for trial in range(40):
        n = int(rng.integers(1, 60))
        totals = [int(x) for x in rng.integers(0, 300, n)]
        weights = [[float(x) for x in totals], [float(x) for x in rng.integers(0, 4, n)], [0.0] * n][trial % 3]
        places = packing.VirtualPlaces(totals, weights, 64, 16)
        spots = {(q, p + k): sequence * 16 + offset + k for q, total in enumerate(totals) for a in range(0, total, 50) for p, size, sequence, offset in places.of(q, a, min(total, a + 50)) for k in range(size)}
        assert sorted(spots.values()) == list(range(sum(totals)))
        if trial % 3 == 0 and sum(totals):
            for k in range(places.blocks):
                assert all(abs(int(t) - x * min(1, k * 64 / sum(totals))) <= 1 for t, x in zip(places._taken(k), totals, strict=True))
        late = [spots[q, p] for q, p in spots if not weights[q]]
        if any(weights) and late:
            assert min(late) + 64 + n >= sum(t for t, w in zip(totals, weights, strict=True) if w)


def test_every_source_is_a_queue(spark):
    rows = [(i, f"word{i} and more words {i}" * (1 + i % 3), f"site{i % 40}") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {f"site{k}": 8.0 if k == 39 else 1.0 for k in range(1, 40)}
    few, many = (packing.pack(frame, WORDS, length=64, window_sequences=4, weights=weights, max_queues=m).collect() for m in (1024, 8))
    assert {r.queue for r in many} == {f"site{k}" for k in range(40)} and all(r.queue == f"site{r.doc_id % 40}" for r in many)
    spots = [sorted(r.sequence_id * 64 + r.offset + k for r in rows for k in range(r.length)) for rows in (few, many)]
    assert spots[0] == spots[1] == list(range(len(spots[0])))
    last = {q: max(r.sequence_id for r in many if r.queue == q) for q in ("site0", "site3", "site39")}
    assert last["site39"] < last["site3"] < last["site0"]
    part = [sum(r.length for r in many if r.queue == q and r.sequence_id < 4) for q in ("site39", "site3")]
    assert part[0] > 5 * part[1] > 0


def test_jaccard(docs):
    got = by_id(jaccard.jaccard_join(docs))
    assert [got[i].n_links for i in (10, 11, 12)] == [2, 2, 2] and [got[i].component_id for i in (10, 11, 12)] == [10] * 3
    assert {i for i in got if not got[i].kept} == {9, 11, 12, 14}
    assert [got[i].n_links for i in (0, 1, 2, 8, 9)] == [0, 0, 0, 1, 1]


def removed(raw, width):
    """Which bytes strings of that width cover that stand twice or more."""
    seen = defaultdict(int)
    for t in raw:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] += 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = True
        out.append(gone)
    return out


def passages_of(text, gone):
    """Bytes and number of the runs of 51 words or 400 bytes."""
    edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0)).reshape(-1, 2).tolist()
    kept = [b - a for a, b in edges if b - a >= 400 or len(text[a:b].split()) >= 51]
    return sum(kept), len(kept)


def spans_of(gone):
    return int((gone[1:] < gone[:-1]).sum())


@pytest.mark.parametrize("most", [4096, 1])
def test_suffix_dedup(docs, monkeypatch, most):
    monkeypatch.setattr(suffixdedup, "MOST", most)
    raw = [(t or "").encode() for t in TEXTS]
    gone, passages = removed(raw, 400), removed(raw, 200)
    for i, r in by_id(suffixdedup.substring_digests(docs)).items():
        kept = bytes(b for b, x in zip(raw[i], gone[i], strict=False) if not x)
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (int(gone[i].sum()), spans_of(gone[i]), hashlib.sha256(kept).hexdigest())
        assert (r.passage_bytes, r.n_passages) == passages_of(raw[i], passages[i])


@pytest.mark.parametrize("most", [4096, 3, 1])
def test_suffix_dedup_of_small_strings(spark, monkeypatch, most):
    """Few letters and short widths, so that anchors are popular, periodic and split many times."""
    monkeypatch.setattr(suffixdedup, "MOST", most)
    rng = np.random.default_rng(most)
    shared = "".join(rng.choice(list("abcd"), 40))
    texts = ["".join(rng.choice(list("ab" if i % 2 else "abcd"), rng.integers(0, 60))) for i in range(40)] + [f"{'x' * i}{shared[i % 7 : 40 - i % 5]}{'y' * (i % 3)}" for i in range(25)] + ["z" * 90, "zy" * 30]
    raw = [t.encode() for t in texts]
    gone, passages = removed(raw, 24), removed(raw, 12)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, r in by_id(suffixdedup.substring_digests(frame, 24, 12, 0)).items():
        assert (r.n_removed, r.n_spans, r.passage_bytes, r.n_passages) == (int(gone[i].sum()), spans_of(gone[i]), int(passages[i].sum()), spans_of(passages[i]))


def launched(spark, path, run):
    """Commands of the processes that the JVM (in local mode also the executor) starts while run() runs."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    recording = jvm.jdk.jfr.Recording()
    recording.enable("jdk.ProcessStart")
    recording.start()
    run()
    recording.stop()
    file = jvm.java.nio.file.Path.of(str(path), gateway.new_array(jvm.String, 0))
    recording.dump(file)
    recording.close()
    return [e.getString("command") for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(file)]


@pytest.mark.parametrize("most", [4096, 1])
def test_suffix_dedup_starts_no_process_for_a_file(spark, docs, monkeypatch, tmp_path, most):
    """A process that starts holds the executor's memory a second time until it runs."""
    monkeypatch.setattr(suffixdedup, "MOST", most)
    spark.range(1).mapInArrow(lambda it: it, "id long").collect()  # the workers' own process
    assert [x for x in launched(spark, tmp_path / "x.jfr", lambda: suffixdedup.substring_digests(docs).collect()) if "chmod" in x] == []


def test_tables_written_by_workers(spark):
    rows = [(i, None if i % 3 else bytes([i]), [i] * (i % 4), (i, str(i))) for i in range(100)]
    frame = spark.createDataFrame(rows, "a long, b binary, c array<long>, d struct<e: long, f: string>").repartition(7)
    back = common.written(frame, "some")
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect())) and back.schema == frame.schema
    assert common.written(frame.where("a < 0"), "none").count() == 0
    twice = common.written(frame, "twice", lambda it: (x for batch in it for x in (batch.select(["a"]), batch.select(["a"]))), "a long")
    assert sorted(r.a for r in twice.collect()) == sorted([*range(100), *range(100)])
    common.discard(back, twice)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(back._stored_at)


def test_interval_tree_like_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(300):
        width, letters = 8, list("ab"[: int(rng.integers(1, 3))])
        rows = {("".join(rng.choice(letters, a)) + "zz" + "".join(rng.choice(letters, b)), a) for a, b in rng.integers(0, 7, (10, 2)).tolist() if a + b >= 6}
        contexts, places = [c.encode() for c, _ in rows], [a for _, a in rows]
        counts = [len(c) - width + 1 for c in contexts]
        for i, found in enumerate(suffixdedup.repeated_windows(contexts, places, counts, width)):
            twice = {w for w in range(counts[i]) if any(j != i and places[j] >= places[i] - w and contexts[j][places[j] - places[i] + w :][:width] == contexts[i][w : w + width] for j in range(len(contexts)))}
            assert {w for a, b in found for w in range(a, b)} == twice


def test_hnsw(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    v = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.05, base[:5]])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0])]
    got = by_id(hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vec_id")
    u = v.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = (u @ u.T >= 0.95).sum(1) - 1
    assert sum(got[i].n_links for i in range(len(v))) >= 0.9 * true.sum()
    assert all(got[i].n_links <= true[i] for i in range(len(v)))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))


@pytest.mark.parametrize("recall", [0.98, 0.0])
def test_hnsw_dense_cluster_and_rare_links(spark, recall):
    """A cluster of 2000 near copies, 40 lone pairs, and searches that miss links: all ends count all links."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2000, 24))
    v = np.concatenate([rng.normal(size=24) * 5 + rng.normal(size=(2000, 24)) * 0.2, base, base[:40] + rng.normal(size=(40, 24)) * 0.03]).astype(np.float32)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = by_id(hnsw.near_duplicates(frame, beam=40 if recall else 1, recall=recall), "vec_id")
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found == near.sum(1) - 1).mean() > (0.999 if recall else 0.5)
    assert all((got[i].n_links, got[i].component_id) == (got[i + 2000].n_links, got[i + 2000].component_id) for i in range(2000, 2040))
    assert got[0].audited_recall >= recall


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.org/es/x", "https://example.org/en/12?q", "http://b.com/fr/", "x.com/de/", None, "http://www.de.com/de/1#f", "http://org/"]
    got = by_id(urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")), "page_id")
    assert [got[i].verdict for i in range(7)] == ["block", "block", "allow", "allow", "allow", "block", "allow"]
    assert [got[i].rule for i in range(7)] == ["example.org/es/", "example.org/en/1", "com/fr/", None, None, "com/de/", "org/"]


def test_cascade_is_exact():
    listed, universe = {f"in{i}" for i in range(200)}, {f"out{i}" for i in range(5000)}
    first = urlfilter.Bloom(listed, 0.3, 0)
    cascade = urlfilter.Cascade(first, listed, {k for k in universe if k in first})
    assert all(k in cascade for k in listed) and not any(k in cascade for k in universe)


def test_chat(spark):
    rows = [(1, 0, "user", "a</s>\x1b<|x"), (1, 1, "assistant", None), (1, 2, "assistant", "[INST] é"), (2, 0, None, ""), (3, 0, "us\ner n\x1b", "<\x1b|<<|"), (3, 0, "us\ner n\x1b", "<\x1b|<<|")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = by_id(chat.conversation_digests(chat.with_probe(frame)), "conv_id")
    assert sorted(got) == [-7, 1, 2, 3]
    for k, r in got.items():
        own = [(r or "", t or "") for c, _, r, t in rows if c == k] if k > 0 else [(x, "</s>[INST] ok [/INST]") for x in ("user", "assistant")]
        loss = "".join(t for r, t in own if r == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(bytes(x.formatted).decode()) for x in chat.format_turns(chat.with_probe(frame)).where(f"conv_id = {k}").collect())


def test_no_control_string_survives_in_a_text(spark):
    rng = np.random.default_rng(6)
    signs = ["<", "|", "s", ">", "/", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "</s>", "<s>", "\x1b", "n", "\n", "x"]
    rows = [(0, i, "".join(rng.choice(signs, 3)), "".join(rng.choice(signs, rng.integers(0, 12)))) for i in range(400)]
    for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        assert chat.parse(bytes(r.formatted)) == rows[r.turn][2:]
        inner = bytes(r.formatted)[len(chat.HEAD) : -len(chat.FOOT)].decode()
        assert not any(c in inner for c in chat.CONTROLS)


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.normal(size=(5, 3, net.FEATURES)), np.ones((5, 3), bool), np.array([1.0, 0.0, 1.0])
    mask[3:, 1] = False

    def loss():
        s = net.states(net.gates(x), np.stack([mask, mask[::-1]]).astype(np.float64))
        logit = net.pooled(s, mask)[0]
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    grads, dx = net.gradients(x, mask, y)
    for name in ("wx", "b", "wh", "wa", "ba", "va", "w", "bias"):
        p, g = net.p[name], np.broadcast_to(grads[name], net.p[name].shape)
        for at in rng.integers(0, p.size, 6):
            at = np.unravel_index(at, p.shape)
            was = p[at]
            p[at] = was + 1e-3
            up = loss()
            p[at] = was - 1e-3
            slope = (up - loss()) / 2e-3
            p[at] = was
            assert abs(slope - g[at]) < 1e-4 + 1e-2 * abs(slope), (name, at, slope, g[at])


def test_toxicity(spark, docs):
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(["ka", "lo", "mi", "tu", "re"], 40)) for _ in range(120)]
    samples = [(t, 0) for t in clean[:60]] + [(t + " vilething", 1) for t in clean[60:90]]
    model = toxicity.train(samples)
    assert (model.scores([t + " vilething" for t in clean[90:]]) >= 0.5).mean() > 0.9 and (model.scores(clean[90:]) < 0.5).mean() > 0.9
    assert toxicity.score_documents(docs, model).count() == len(TEXTS)
    assert toxicity.train([]).network is None


def test_toxicity_sample_takes_a_text_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda samples: samples)
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    held = {i for i in (1, 2) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert toxicity.fit(docs, labels) == [x for i, x in ((1, ("a", 1)), (2, ("c", 0))) if i not in held]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    for df in (bpe.digests(docs, WORDS), token_counts.count_tokens(docs, BYTES), telephony.media_digests(docs), telephony.store_texts(docs), chat.conversation_digests(spark.createDataFrame([], 'conv_id long, turn long, role string, text string')), toxicity.score_documents(docs, toxicity.train([])), packing.pack(docs, WORDS), jaccard.jaccard_join(docs), suffixdedup.substring_digests(docs), urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")), hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert df.count() == 0
