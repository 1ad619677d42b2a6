"""Fill-in-middle, benchmark decontamination and zone-mapped clustering against brute force, on
tables with nulls, empty and long texts, ties, repeated rows, clashing columns and none at all."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fim, fm_index, zone_clusters
from tessera.llm.common import prepare

SCHEMA = "doc_id long, text string, uid string, output string, form string, row_0 int, spans string, n int, t string, key string"


def _rows(texts):
    return [(i, t, "u", "o", "f", 1, "s", 2, "t", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def ready(spark):
    prepare(spark)
    return spark


# ------------------------------------------------------------------ 11 fill in the middle
def _fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def _fim_texts():
    rnd = random.Random(3)
    bits = ["a", "é", "\U0001f600", "<", "P>", "S", "M>", "<P", "中", " ", "\n", "\x00"]
    made = ["".join(rnd.choice(bits) for _ in range(rnd.choice([1, 2, 3, 9, 60]))) for _ in range(400)]
    return made + [None, "", "x", "<P>", "<M", "a<S>b", "né " * 400_000, made[0], made[0]]


def test_fim_equals_brute_force_and_restores(ready):
    rows = _rows(_fim_texts()) + [(None, "no id", "u", "o", "f", 1, "s", 2, "t", "k"), (3, "id again", "u", "o", "f", 1, "s", 2, "t", "k")]
    out = fim.restore(fim.transform(ready.createDataFrame(rows, SCHEMA).repartition(3)), into="n_chars")
    got = sorted((repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output), bytes(r.n_chars))) for r in out.collect()))
    want = sorted(repr((r[0], *_fim(r[0], r[1])[:4], _fim(r[0], r[1])[4].encode(), (r[1] or "").encode())) for r in rows)
    assert got == want
    assert {r.form for r in out.select("form").distinct().collect()} == set(fim.FORMS)


def test_fim_windows_do_not_change_the_result(ready, monkeypatch):
    text = "".join(chr(97 + i % 26) + "é" for i in range(5000)).encode()
    flat, ends = np.frombuffer(text * 2, np.uint8), np.asarray([0, 0, len(text), 2 * len(text)])
    h = [np.asarray([5, 1234, 99]), np.asarray([8, 8000, 7000]), np.asarray([0, 0, 0]), np.asarray([0, 50, 10])]
    whole = fim.arrange(flat, ends, h)
    monkeypatch.setattr(fim, "WINDOW", 97)
    for a, b in zip(whole, fim.arrange(flat, ends, h)):
        assert (a == b).all()
    back, back_ends, bad = fim.rebuild(whole[0], whole[1], whole[3])
    assert back.tobytes() == text * 2 and (back_ends == ends).all() and not bad.any()


def test_fim_restore_refuses_what_is_no_output(ready):
    rows = [(1, None, "psm"), (2, "<P>a<S>b<M>c", None), (3, "<P>a<S>b<M>c", "other"), (4, "<P>a<M>b<S>c", "psm"), (5, "a<P>b<S>c<M>d", "psm"),
            (6, "<P>a<S>b<M>c", "spm"), (7, "<P>a<S>b<S>c<M>d", "psm"), (8, "<P>a<S>b<M>c", "psm"), (9, "<S>b<P>a<M>c", "spm"), (10, "<P>x", "plain"),
            (11, "", "psm")]
    out = {r.doc_id: r.restored for r in fim.restore(ready.createDataFrame(rows, "doc_id long, output string, form string")).collect()}
    assert {k: bytes(v) for k, v in out.items() if v is not None} == {8: b"acb", 9: b"acb", 10: b"<P>x"} and len(out) == 11


def test_fim_empty_table(ready):
    assert fim.restore(fim.transform(ready.createDataFrame([], SCHEMA))).collect() == []


# ------------------------------------------------------------------ 12 decontamination
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _contaminated(texts, items, window):
    wins = {}
    for name, t in items:
        w = _words(t)
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i:i + k]), set()).add("" if name is None else str(name))
    sizes = {len(k) for k in wins}
    out = []
    for t in texts:
        w, hit, found = _words(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in wins:
                    hit.update(range(i, i + k))
                    found |= wins[tuple(w[i:i + k])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def _decontamination_tables():
    rnd = random.Random(11)
    voc = ["Ab", "cd", "é1", "中", "x9", "THE", "of", "q"]
    say = lambda n: rnd.choice([" ", ", ", "\n", "--"]).join(rnd.choice(voc) for _ in range(n))
    items = [(i, say(rnd.choice([1, 3, 9, 10, 11, 30]))) for i in range(25)] + [(None, say(12)), (3, say(14)), (7, None), (8, ""), (9, "?!"),
                                                                             (40, "zebra"), (41, say(40))]
    texts = [say(rnd.choice([1, 5, 20, 60])) for _ in range(60)]
    texts += [say(8) + " " + (t or "").upper() + "; " + say(8) for _, t in items]
    texts += [None, "", " \x85", "zebra", "ZEBRA zebra", "zebras", texts[0], texts[0], "q " * 3000 + texts[70], items[-1][1] * 3]
    return texts, items


@pytest.mark.parametrize("window,shard_words,block_words", [(10, 1 << 20, 1 << 16), (10, 50, 40), (4, 7, 5), (1, 3, 2)])
def test_decontamination_equals_brute_force(ready, monkeypatch, window, shard_words, block_words):
    monkeypatch.setattr(fm_index, "BLOCK_WORDS", block_words)
    texts, items = _decontamination_tables()
    items = items if block_words > 100 else items[-6:]
    docs = ready.createDataFrame(_rows(texts), SCHEMA).repartition(3)
    bench = ready.createDataFrame([(n, t, 1) for n, t in items], "item_id long, text string, uid int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in
           fm_index.report(docs, bench, window=window, shard_words=shard_words).collect()}
    assert [got[i] for i in range(len(texts))] == _contaminated(texts, items, window)


def test_decontamination_repeated_and_null_ids_and_empty_tables(ready):
    texts, items = _decontamination_tables()
    docs = ready.createDataFrame([(r[0] if r[0] % 9 else (None if r[0] % 2 else 5), *r[1:]) for r in _rows(texts)], SCHEMA)
    bench = ready.createDataFrame([(n, t) for n, t in items], "item_id long, text string")
    out = fm_index.report(docs, bench)
    assert sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in out.collect()) == sorted(_contaminated(texts, items, 10))
    assert fm_index.report(docs.limit(0), bench).collect() == []
    clean = fm_index.report(docs, bench.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated or r.n_hit or r.n_items for r in clean)


def test_suffix_order_and_positions():
    rnd = random.Random(4)
    for _ in range(30):
        pieces = [np.asarray([rnd.randrange(3) for _ in range(rnd.choice([1, 2, 30, 80]))], np.int32) for _ in range(rnd.choice([1, 4, 9]))]
        pieces += pieces[:2]
        shard = fm_index.Shard(fm_index.build_shard(pieces, [b"a", b"b", b"c"], [(i, i, 0) for i in range(len(pieces))]))
        t = [x for p in pieces for x in [*(int(y) + 1 for y in p), 0]]
        words = np.asarray([rnd.randrange(4) for _ in range(60)])
        start, length = np.arange(50), np.asarray([rnd.randrange(1, 8) for _ in range(50)])
        for s, k, lo, hi in zip(start, length, *shard.find(words, start, length)):
            want = [int(x) for x in words[s:s + k]]
            assert sorted(shard.positions(np.arange(lo, hi)).tolist()) == [i for i in range(len(t)) if 0 not in want and t[i:i + k] == want]


def test_remove_cuts_spans_and_keeps_columns(ready):
    item = "one two three four five six seven eight nine ten eleven"
    rows = _rows([f"Before it. {item.upper()}! After, it.", "nothing here", None, f"{item} {item}", item.replace("four", "for")])
    out = fm_index.remove(ready.createDataFrame(rows, SCHEMA), ready.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "Before it. ! After, it.", 1: "nothing here", 2: None, 3: "", 4: rows[4][1]}


# ------------------------------------------------------------------ 13 clusters
def _kmeans(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        new = list(c)
        for j in set(of):
            members = [v for (_, v), o in zip(kept, of) if o == j]
            new[j] = [sum(x) // len(members) for x in zip(*members)]
        c = new
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, o, d in out if o == j) for _, j, _ in out}
    return sorted(repr((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())) for i, j, d in out)


def _vectors(large=1.0):
    rnd = random.Random(8)
    middle = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [large * (m + rnd.gauss(0, rnd.choice([0.02, 0.5]))) for m in middle[i % 6]]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(7, rows[9][1]), (7, rows[7][1]), (None, rows[8][1]), (None, [0.0] * 64)]
    return rows + [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] + [0.0] * 63),
                   (2005, [float("inf")] + [0.0] * 63), (2006, [1.0] * 65)]


@pytest.mark.parametrize("k,rounds,large,block", [(40, 5, 1.0, 128), (5, 3, 1.0, 7), (12, 2, 90_000.0, 16), (1, 1, 1.0, 1)])
def test_clusters_equal_brute_force(ready, monkeypatch, k, rounds, large, block):
    monkeypatch.setattr(zone_clusters, "BLOCK", block)
    rows = _vectors(large)
    df = ready.createDataFrame([(i, v, 3, "r", 9) for i, v in rows], "vec_id long, embedding array<double>, cluster int, row string, place int")
    got = sorted(repr(tuple(r)) for r in zone_clusters.cluster(df.repartition(5), centroids=k, rounds=rounds).collect())
    assert got == _kmeans(rows, k, rounds)


def test_clusters_of_few_vectors_none_and_too_large(ready):
    kind = "vec_id long, embedding array<double>"
    rows = _vectors()[:3]
    assert sorted(repr(tuple(r)) for r in zone_clusters.cluster(ready.createDataFrame(rows, kind)).collect()) == _kmeans(rows, 40, 5)
    assert zone_clusters.cluster(ready.createDataFrame([], kind)).collect() == []
    assert zone_clusters.cluster(ready.createDataFrame([(1, None)], kind)).collect() == []
    with pytest.raises(ValueError, match="would not fit"):
        zone_clusters.cluster(ready.createDataFrame([(1, [1e9] * 64)], kind))


def test_hilbert_keys_walk_neighbouring_cells():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
        key = zone_clusters.hilbert_keys(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_box_candidates_hold_every_nearest_centroid():
    rnd = np.random.default_rng(2)
    pruned = 0
    for _ in range(200):
        c = rnd.integers(-300, 300, (12, 64))
        v = c[rnd.integers(12)] + rnd.integers(-40, 40, (20, 64))
        left = zone_clusters.candidates(v.min(0), v.max(0), c)
        assert set(zone_clusters.nearest(v, c)[0]) <= set(left.tolist())
        pruned += 12 - len(left)
    assert pruned > 1000


# ------------------------------------------------------------------ 2 warc: ranges and reader
def test_warc_ranges_follow_ids_however_spread(ready):
    from tessera.llm import warc
    rnd = random.Random(12)
    sparse = [rnd.randrange(-2 ** 62, 2 ** 62) for _ in range(300)]
    rows = [(i, f"u{k}", f"<p>{k}</p>", "s", 1, 2, "d") for k, i in enumerate(sparse)]
    rows += [(sparse[7], f"r{k}", f"<p>again {k % 90}</p>", "s", 1, 2, "d") for k in range(200)]                   # one repeated id
    rows += [(None, f"n{k}", f"<p>none {k}</p>", "s", 1, 2, "d") for k in range(70)] + [(5, None, None, "s", 1, 2, "d")]
    pages = ready.createDataFrame(rows, "page_id long, url string, html string, shard string, part int, parts int, digest string")
    found = []
    for n in (1, 6):
        path = warc.archive_path(ready)
        manifest = warc.write(pages.repartition(n), path, rows_per_shard=20).collect()
        found.append(sorted((r.file, r.sha256, r.records) for r in manifest))
        out = warc.read(ready, path).collect()
        assert len(out) == len(rows) and all(r.digest_ok for r in out)
    assert found[0] == found[1]
    ranges = sorted((r.shard, r.first_id, r.last_id) for r in manifest if r.shard >= 0 and r.part == 0)
    assert 14 <= len(ranges) <= 17 and all(a[2] < b[1] for a, b in zip(ranges, ranges[1:]))
    assert len({r.part for r in manifest if r.part and r.shard >= 0}) >= 8 and len({r.part for r in manifest if r.shard < 0}) >= 3
    assert max(r.records for r in manifest) <= 60
    # tasks without rows write nothing
    few = warc.archive_path(ready)
    assert [r.records for r in warc.write(pages.filter("page_id = 5"), few).collect()] == [1] and warc.read(ready, few).count() == 1


def test_warc_reader_of_long_and_short_records():
    from tessera.llm import warc
    rnd = random.Random(1)
    payloads = [b"", b"x", rnd.randbytes(300_000), b"y" * 2_000_000] + [rnd.randbytes(rnd.randrange(3000)) for _ in range(300)]
    data = b"".join(warc._gzip(warc.record(i, "u", p, warc.payload_digest(p), None, False)) for i, p in enumerate(payloads))
    out = list(warc.parse(data))
    assert [r.block.partition(b"\r\n\r\n")[2] for r in out] == payloads and [int(r.head["X-Page-Id"]) for r in out] == list(range(len(payloads)))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(data[:-3]))
    assert list(warc.parse(b"")) == []


# ------------------------------------------------------------------ 4 mixing: the permutation itself
def _hash(*values):
    """Spark's xxhash64 of a row: each value with the hash so far as seed."""
    import xxhash
    h = 42
    for v in values:
        if isinstance(v, str):
            raw = v.encode()
        else:
            n, size = v
            raw = n.to_bytes(size, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def _mixed_by_hand(rows, block_tokens, **kw):
    from tessera.llm import mixing
    i4, i8 = lambda n: (n, 4), lambda n: (n, 8)
    name = lambda s: mixing.NO_SOURCE if s is None else s
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    tokens = {}
    for _, t, s in rows:
        tokens[name(s)] = tokens.get(name(s), 0) + size(t)
    plan = mixing.solve(tokens, **kw)
    out = {}
    for s, total, _, budget in plan.rows:
        epochs = math.floor(budget / total + 1e-9) if total else 1
        rest = max(0.0, budget - epochs * total) if total else 0.0
        rest = rest if rest > 1e-6 * total else 0.0
        blocks = max(1, math.ceil(total / block_tokens))
        own = [(str(i), _hash(t or ""), size(t), (i, t)) for i, t, x in rows if name(x) == s]
        block = {r: _hash(i4(mixing.SEED), r[0], i8(r[1])) % blocks for r in own}
        order = lambda b: (_hash(i4(mixing.SEED), s, i4(epochs), i8(b)), b)
        inner = lambda r: (_hash(i4(mixing.SEED + 1), i4(epochs), r[0], i8(r[1])), r[0], r[1])
        taken, spent = set(), 0.0
        for b in sorted(set(block.values()), key=order):
            if spent >= rest:
                break
            whole = sum(r[2] for r in own if block[r] == b)
            if spent + whole < rest:
                taken |= {r for r in own if block[r] == b}
            else:
                part = 0
                for r in sorted((r for r in own if block[r] == b), key=inner):
                    if part < rest - spent:
                        taken.add(r)
                    part += r[2]
            spent += whole
        for r in own:
            out[r[3]] = epochs + (r in taken)
    return plan, out


@pytest.mark.parametrize("small", [200_000, 1])
def test_mixing_equals_the_permutation_by_hand(ready, monkeypatch, small):
    """Quotas, block order and the edge block; with tables of sources broadcast and joined by a shuffle."""
    from tessera.llm import mixing
    monkeypatch.setattr(mixing, "SMALL_SOURCES", small)
    rnd = random.Random(17)
    rows = [(i, " ".join("w" + str(rnd.randrange(99)) for _ in range(rnd.randrange(1, 60))), rnd.choice(["a", "b", "b", "b", "c", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "empty"), (902, " \n", "empty")]
    schema = "doc_id long, text string, source string"
    df = ready.createDataFrame([(*r, 1, "m", 2, "k") for r in rows], schema + ", mix0_e int, _me string, mix_order int, mix1_s string").repartition(3)
    for kw in ({}, {"budget": 9000.0, "max_epochs": 9.0}, {"entropy_share": 0.999, "max_epochs": 50.0}):
        plan, want = _mixed_by_hand(rows, 200, **kw)
        mixed, got = mixing.mix(df, block_tokens=200, **kw)
        assert {(r.doc_id, r.text): r.mix_epochs for r in mixed.collect()} == want
        assert got.exponent == pytest.approx(plan.exponent, abs=1e-9) and got.budget == pytest.approx(plan.budget)
        assert len(got.rows) == (len(plan.rows) if small > 100 else 0)
        assert set(df.columns) <= set(mixed.columns)


def test_mixing_of_many_sources_counts_them_together():
    from tessera.llm import mixing
    tokens = {f"s{i}": 10 + i % 7 for i in range(3000)}
    sizes, counts = np.unique(list(tokens.values()), return_counts=True)
    one, many = mixing.solve(tokens), mixing.solve_counts(sizes, counts)
    assert one.exponent == pytest.approx(many.exponent) and one.budget == pytest.approx(many.budget) and one.norm == pytest.approx(many.norm)


# ------------------------------------------------------------------ 6 and 9: odd columns and rows
def test_pieces_keep_columns_of_any_name(ready):
    from tessera.llm import pieces
    df = ready.createDataFrame([(1, "one two", "p", 7, "q"), (2, None, None, None, None)], "doc_id long, text string, piece_text string, ids int, piece_text0 string")
    out = pieces.encode_documents(df, keep=("piece_text", "ids", "piece_text0"))
    assert out.columns == ["doc_id", "piece_text", "ids_in", "piece_text0", "n_pieces", "ids", "ids_sha256", "round_trip"]
    rows = {r.doc_id: r for r in out.collect()}
    assert (rows[1].piece_text, rows[1].ids_in, rows[1].piece_text0, rows[1].round_trip) == ("p", 7, "q", True) and rows[2].n_pieces == 0


def test_chat_reads_back_records_that_were_not_formatted(ready):
    from tessera.llm import chat_format
    df = ready.createDataFrame([(1, '{"what": 1}', "old"), (2, "no json", "old"), (3, None, "old"), (4, '{"prompt": "a", "response": "b"}', "old")],
                               "conv_id long, record string, chat string")
    out = chat_format.format_records(df)
    rows = {r.conv_id: r.r for r in out.select("conv_id", chat_format.read_back(F.col("chat.formatted"), F.col("chat.mask")).alias("r")).collect()}
    assert rows[4].n_turns == 2 and all(rows[i].n_turns is None for i in (1, 2, 3))


def test_ppm_packs_texts_and_joins_scores_once(spark):
    from tessera.llm import ppm
    rows = [(1, 10, b"ab c"), (None, 11, b""), (3, 12, "é".encode() * 50)]
    ids, uids, lengths, packed = ppm._packed(rows)
    assert list(zip(ids, uids, ppm._unpacked(lengths, packed))) == rows
    assert ppm._unpacked(*ppm._packed([(1, 1, b""), (2, 2, b"")])[2:]) == [b"", b""]
    docs = spark.createDataFrame([(i, f"some words {i} here" * (i % 3)) for i in range(40)] + [(40, None)], "doc_id long, text string")
    out = ppm.score_documents(docs, ppm.fit(docs, ~ppm.held_out(F.col("doc_id")), order=4))
    # rare words are taken from the scored rows alone, not from their join with the long scores
    assert len(re.findall(r"Relation \[uid#\d+L?,score#\d+\] parquet", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert out.count() == 41 and out.filter("score is null").count() == 0
