"""The dealt operators against brute force on small tables with nulls, empty and long texts,
ties, repeated rows, clashing extra columns and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, crf, exact_dedup, mixing, ngram_join, pieces, pii, ppm, quality_lines, toxicity, warc
from tessera.llm.common import ship
from tessera.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, digest string, row_0 int, kind string"


def _lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def _texts():
    rnd = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "né", "éa", "x", "the", "of", "▁", "\U0001f600y", "no break"]
    base = [" ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(60)) for _ in range(12)]
    near = []
    for b in base[:4]:
        for _ in range(5):
            w = b.split(" ")
            w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(9))
            near.append(" ".join(w))
    odd = [None, "", " \t\n", "one", "One", "a b c", "a  b\nc", "tab\tsep\x0bvt\x0cff\rcr", "x" * 5000, "q w e " * 3000,
           "mail a.b@c-d.org, 10.0.0.256 1.2.3.4 and 1.2.3.4.5.6.7.8 +1 (234) 555-2485 4111 1111 1111 1111 né a@b_c@d.ef",
           "\U0001f600 +12 345 678 90 0-0 079927398713 x@y@z.com ++1 2345678 9 password=a9ce335683f9772ddc",
           "same line\nsame line\nother\n\n same line\nsame line", "# $ | <a> & * %", "\n\n\n", "nul\x00 byte\x1csep\x85nel"]
    return base + near + odd + base[:3] + [" ".join(base[5].split(" ")) + " ", "one"]


def _frame(spark, texts, first=0):
    rows = [(first + i, t, "en", None if i % 7 == 3 else f"s{i % 3}", 1, "u", "d", 5, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    texts = _texts()
    extra = [(None, texts[0], "en", None, 1, "u", "d", 5, "k"), (0, texts[0], "en", "s0", 1, "u", "d", 5, "k")]
    return _frame(spark, texts).union(spark.createDataFrame(extra, SCHEMA)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def _labels(spark, n, column):
    return spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], f"doc_id long, {column} int")


# ------------------------------------------------------------------ the chain itself
def _paths(lengths, e, m):
    """Brute force over all state sequences: marginals and the best one."""
    at, z, best = 0, [], []
    for n in lengths:
        w = e[at:at + n]
        score = {}
        for y in itertools.product((0, 1), repeat=n):
            s = sum(x for x, k in zip(w, y) if k) + (m.start if n and y[0] else 0)
            s += sum({(0, 1): m.enter, (1, 0): m.leave, (1, 1): m.stay, (0, 0): 0}[p] for p in zip(y, y[1:]))
            score[y] = s
        for i in range(n):
            one = sum(math.exp(s) for y, s in score.items() if y[i])
            z.append(math.log(one) - math.log(sum(math.exp(s) for y, s in score.items() if not y[i])))
        best += max(score, key=lambda y: score[y]) if n else ()
        at += n
    return np.asarray(z), np.asarray(best, bool)


def test_chain_recursions_match_enumeration():
    rnd = np.random.default_rng(3)
    m = crf.Chain(-0.4, -0.7, 0.3, 0.9, 0.0, np.zeros(0))
    lengths = np.asarray([3, 0, 7, 1, 5, 0])
    e = rnd.normal(size=lengths.sum())
    z, y = _paths(lengths, e, m)
    assert np.allclose(crf.marginals(lengths, e, m), z)
    assert (crf.viterbi(lengths, e, m) == y).all()


def test_chain_gradient_is_the_slope_of_the_likelihood():
    rnd = np.random.default_rng(4)
    lengths, n = np.asarray([4, 2, 0, 3]), 9
    tok, feat = np.arange(n), rnd.integers(0, 3, n)
    labels = rnd.integers(0, 2, n).astype(np.uint8)

    def loglik(v):
        m, at, total = crf.Chain.of(v), 0, 0.0
        e = crf.emissions(n, tok, feat, m)
        for k in lengths:
            w, y = e[at:at + k], labels[at:at + k]
            s = lambda q: (sum(x for x, b in zip(w, q) if b) + (m.start if len(q) and q[0] else 0)
                           + sum({(0, 1): m.enter, (1, 0): m.leave, (1, 1): m.stay, (0, 0): 0}[p] for p in zip(q, q[1:])))
            total += s(tuple(int(x) for x in y)) - math.log(sum(math.exp(s(q)) for q in itertools.product((0, 1), repeat=k)))
            at += k
        return total

    v = rnd.normal(size=8)
    g = crf.gradient(lengths, tok, feat, labels, crf.Chain.of(v))
    for i in range(8):
        d = np.zeros(8)
        d[i] = 1e-5
        assert abs((loglik(v + d) - loglik(v - d)) / 2e-5 - g[i]) < 1e-4


# ------------------------------------------------------------------ 1 toxicity
def test_toxicity_learns_stems_and_spares_clean_texts(spark, empty):
    ship(spark)
    rnd = random.Random(2)
    clean = ["and", "the", "house", "river", "garden", "walks", "slowly"]
    texts, toxic = [], []
    for i in range(240):
        w = [rnd.choice(clean) + str(rnd.randrange(50)) for _ in range(30)]
        if i % 3 == 0:
            for _ in range(2):
                w[rnd.randrange(30)] = "vilew" + rnd.choice("abcdefgh") + rnd.choice("abcdefgh") + ","
        texts.append(" ".join(w))
        toxic.append(int(i % 3 == 0))
    texts[3], texts[6] = None, ""
    docs = _frame(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0 and texts[i]]
    assert all(out[i].held_out for i in held)
    assert sum(out[i].predicted == toxic[i] for i in held) / len(held) > 0.95
    assert 0 <= out[3].score < 0.5 and out[3].predicted == 0 and out[6].score == out[3].score
    hit = next(i for i in held if toxic[i])
    first, last = map(int, out[hit].spans.split(",")[0].split(":"))
    assert all(w.startswith("vilew") for w in texts[hit].split()[first:last])
    assert toxicity.score_documents(empty, model).count() == 0


def test_toxicity_without_labels_or_with_one_class(docs, empty, spark):
    for labels in (spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")):
        out = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_documents(empty, toxicity.fit(empty, _labels(spark, 9, "toxic"))).count() == 0


# ------------------------------------------------------------------ 2 warc
def test_warc_round_trip_revisits_and_determinism(spark):
    ship(spark)
    rows = [(i, f"http://h/{i} é\r\nx", None if i % 11 == 0 else f"<p>{i % 5}</p>\r\n\r\n" + "x" * (i * 37 % 900)) for i in range(60)]
    rows += [(7, rows[7][1], rows[7][2]), (None, None, "<p>null id</p>"), (None, "u", "<p>null id</p>"), (200, None, rows[9][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = []
    for n in (1, 4):
        path = warc.archive_path(spark)
        manifest = warc.write(pages.repartition(n), path, rows_per_shard=16, roll_bytes=1500).collect()
        files.append(sorted((r.file, r.sha256, r.records) for r in manifest))
        out = warc.read(spark, path).collect()
        assert len(out) == len(rows) and all(r.digest_ok for r in out)
        assert any(r.roll > 0 for r in manifest)
    assert files[0] == files[1]
    payload = {i: (h or "").encode() for i, _, h in rows if i is not None}
    least = {}
    for i, p in payload.items():
        least[p] = min(i, least.get(p, i))
    seen = collections.Counter()
    for r in out:
        if r.page_id is None:
            continue
        p = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), warc.payload_digest(p))
        seen[r.record_type, p] += 1
        if r.record_type == "response":
            assert r.page_id == least[p] and r.refers_to is None and bytes(r.payload) == p
        else:
            assert r.refers_to == least[p]
    assert all(seen["response", p] == 1 for p in least)
    assert warc.read(spark, _written(spark, pages.limit(0))).count() == 0
    assert all(r.record_type == "response" for r in warc.read(spark, _written(spark, pages, revisit_bytes=10 ** 6)).collect())


def _written(spark, pages, **kw):
    path = warc.archive_path(spark)
    warc.write(pages, path, **kw)
    return path


# ------------------------------------------------------------------ 3 quality
def _base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, repeats = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeats, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_base_figures_and_verdict(spark, docs, empty):
    labels = _labels(spark, 40, "quality")
    model = quality_lines.fit(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    out = quality_lines.judge(docs, model).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(text[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality_lines.judge(empty, model).count() == 0
    none = quality_lines.fit(empty, labels)
    assert none.chain is None and all(r.kept != r.base_failed for r in quality_lines.judge(docs, none).collect())


def test_quality_rejects_boilerplate_documents(spark):
    ship(spark)
    rnd = random.Random(9)
    prose = lambda: "\n".join(" ".join(rnd.choice(["river", "stone", "walks", "over"]) + str(rnd.randrange(99)) for _ in range(14)) + "." for _ in range(6))
    menu = lambda: " | ".join(rnd.choice(["HOME", "LOGIN", "BUY"]) + str(rnd.randrange(99)) + "!!" for _ in range(70))
    texts = [menu() if i % 2 else prose() for i in range(120)]
    docs = _frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(80)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_lines.judge(docs, quality_lines.fit(docs, labels)).collect()}
    assert all(out[i] == (i % 2 == 0) for i in range(80, 120))


def test_repeated_words_falls_back_when_ids_do_not_pack():
    ids = np.asarray([5, 9, 2, 7, 5, 9, 2, 1], np.int64)
    assert quality_lines.repeated_words(ids, 10) == quality_lines.repeated_words(ids, 1 << 22) == 6


# ------------------------------------------------------------------ 4 mixing
def test_mixing_meets_entropy_and_limit():
    plan = mixing.solve({"a": 1000, "b": 10, "c": 100, "z": 0}, entropy_share=0.9, max_epochs=1e9)
    w = [r[2] for r in plan.rows if r[2]]
    assert abs(sum(w) - 1) < 1e-9 and abs(mixing._entropy(w) - 0.9 * math.log(3)) < 1e-6
    plan = mixing.solve({"a": 1000, "b": 10, "c": 100}, entropy_share=0.99, max_epochs=3)
    assert max(b / t for _, t, _, b in plan.rows) <= 3 + 1e-6 and min(b / t for _, t, _, b in plan.rows) >= 1 - 1e-9
    assert mixing.solve({}).rows == () and mixing.solve({"a": 0}).rows == (("a", 0, 0.0, 0.0),)


def test_mixing_spends_the_budget_and_keeps_whole_epochs(docs, empty):
    tokens = {}
    size = {}
    for r in docs.collect():
        n = len(WORD.findall(r.text or ""))
        s = r.source if r.source is not None else mixing.NO_SOURCE
        tokens[s] = tokens.get(s, 0) + n
        size[r.doc_id, r.text] = n
    for budget in (None, 3000.0, sum(tokens.values()) * 2.0):
        mixed, plan = mixing.mix(docs, budget=budget, max_epochs=5, block_tokens=500)
        rows = mixed.collect()
        assert len(rows) == docs.count()
        spent = collections.Counter()
        for r in rows:
            spent[r.source if r.source is not None else mixing.NO_SOURCE] += r.mix_epochs * size[r.doc_id, r.text]
        longest = max(size.values())
        for s, t, _, b in plan.rows:
            assert b - 1 <= spent[s] <= b + 2 * longest
            per = {r.mix_epochs for r in rows if (r.source if r.source is not None else mixing.NO_SOURCE) == s}
            assert max(per) - min(per) <= 1
        if budget is None:
            assert min(r.mix_epochs for r in rows) >= 1
        assert mixing.realise(mixed).count() == sum(r.mix_epochs for r in rows)
    assert mixing.realise(mixing.mix(empty)[0]).count() == 0


# ------------------------------------------------------------------ 5 ppm
def _ppm_logp(train, text):
    """PPM by method C with exclusion, straight from context counts."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        b = [255, 255, *t.encode(), 255]
        for i in range(2, len(b)):
            for k in range(3):
                counts[tuple(b[i - k:i])][b[i]] += 1
    b, total = [255, 255, *text.encode(), 255], 0.0
    for i in range(2, len(b)):
        gone, p = set(), 1.0
        for k in (2, 1, 0):
            c = {s: n for s, n in counts[tuple(b[i - k:i])].items() if s not in gone}
            if not c:
                continue
            full = len(gone | set(c)) == 256
            mass = sum(c.values()) + (0 if full else len(c))
            if b[i] in c:
                p *= c[b[i]] / mass
                break
            p *= len(c) / mass
            gone |= set(c)
        else:
            p /= 256 - len(gone)
        total += math.log10(p)
    return total


def test_ppm_matches_direct_counts(docs, empty):
    rows = docs.collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    train = [_lower(r.text or "") for r in rows if fold(r.doc_id) != 1]
    c = collections.Counter(w for t in train for w in [*WORD.findall(t), ""])
    n, v = sum(c.values()), len(c)
    model = ppm.fit(docs, ~ppm.held_out(F.col("doc_id")))
    text = {r.doc_id: _lower(r.text or "") for r in rows}
    out = ppm.score_documents(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        w = [*WORD.findall(text[r.doc_id]), ""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in w)) < 1e-6 * len(w)
        if len(text[r.doc_id]) < 700:
            assert abs(r.score - _ppm_logp(train, text[r.doc_id])) < 1e-3
    none = ppm.fit(empty, F.lit(True))
    one = ppm.score_documents(docs, none).filter("n_tokens = 2").first()
    assert one.train_tokens == 0 and ppm.score_documents(empty, model).count() == 0


def test_ppm_joins_rare_words(docs, monkeypatch):
    whole = {r.uid: r for r in _scored(docs)}
    monkeypatch.setattr(ppm, "HEAVY", 20)
    for r in _scored(docs):
        assert r.n_known == whole[r.uid].n_known and abs(r.base_score - whole[r.uid].base_score) < 1e-6 * r.n_tokens


def _long_logp(train, text, order):
    """``_ppm_logp`` for any order."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        b = [255] * order + [*t.encode(), 255]
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[tuple(b[i - k:i])][b[i]] += 1
    b, total = [255] * order + [*text.encode(), 255], 0.0
    for i in range(order, len(b)):
        gone, p = set(), 1.0
        for k in range(order, -1, -1):
            c = {s: n for s, n in counts[tuple(b[i - k:i])].items() if s not in gone}
            if not c:
                continue
            if b[i] in c:
                p *= c[b[i]] / (sum(c.values()) + len(c))
                break
            p *= len(c) / (sum(c.values()) + len(c))
            gone |= set(c)
        else:
            p /= 256 - len(gone)
        total += math.log10(p)
    return total


def test_ppm_longer_order_matches_direct_counts(docs, empty, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 3000)
    d = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = d.collect()
    train = [_lower(r.text or "") for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    text = {r.doc_id: _lower(r.text or "") for r in rows if len(r.text or "") < 500}
    model = ppm.fit(d, ~ppm.held_out(F.col("doc_id")), order=4)
    out = ppm.score_documents(d, model).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id in text:
            assert abs(r.score - _long_logp(train, text[r.doc_id], 4)) < 1e-3
    assert ppm.score_documents(empty, model).count() == 0
    none = ppm.score_documents(d, ppm.fit(empty, F.lit(True), order=4)).filter("n_tokens = 2").first()
    assert none.train_tokens == 0


def _scored(docs):
    d = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    return [r for r in ppm.score_documents(d, ppm.fit(d, ~ppm.held_out(F.col("doc_id")))).withColumn("uid", F.col("doc_id")).collect()]


# ------------------------------------------------------------------ 6 pieces
def _best(w, v):
    best = [(0.0, [])]
    for j in range(1, len(w) + 1):
        found = None
        for i in range(j):
            hit = v.scores.get(w[i:j])
            if hit is not None and (found is None or best[i][0] + hit[0] > found[0]):
                found = (best[i][0] + hit[0], best[i][1] + [hit[1]])
        if found is None or found[0] < pieces.BYTE_SCORE / 2:
            raw = w[j - 1].encode()
            s = best[j - 1][0] + pieces.BYTE_SCORE * len(raw)
            if found is None or s > found[0]:
                found = (s, best[j - 1][1] + [v.byte_ids[b] for b in raw])
        best.append(found)
    return best[-1][1]


def test_pieces_best_segmentation_and_round_trip(docs, empty):
    v = pieces.load_vocabulary()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    out = pieces.encode_documents(docs, keep=("lang",)).collect()
    assert len(out) == docs.count() and all(r.round_trip for r in out)
    for r in out:
        if len(text[r.doc_id]) < 2000:
            assert r.ids == [x for w in pieces.CUT.findall(text[r.doc_id]) for x in _best(w, v)]
        assert r.n_pieces == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.asarray(r.ids, np.int32).tobytes()).hexdigest()
    back = pieces.encode_documents(docs).select("doc_id", pieces.decoder()("ids").alias("t")).collect()
    assert all(r.t == text[r.doc_id] for r in back)
    assert pieces.encode_documents(empty).count() == 0


# ------------------------------------------------------------------ 7 pii
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(int(x) if i % 2 == 0 else (2 * int(x) - 9 * (2 * int(x) > 9)) for i, x in enumerate(reversed(d))) % 10 == 0


def _valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")),
            "card": 13 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def test_pii_base_spans_stay_and_added_spans_do_not_overlap(docs, empty):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    out = pii.detect(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text[r.doc_id]) if _valid(k, m[0])] for k, p in RULES.items()]
        base = ",".join(itertools.chain(*spans))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in spans]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        cover = [tuple(map(int, s.split(":")[1:])) for s in itertools.chain(*spans)]
        for s in r.spans.split(","):
            if s.startswith("other"):
                a, b = map(int, s.split(":")[1:])
                assert all(e <= a or b <= x for x, e in cover)
    assert pii.detect(empty).count() == 0


def test_pii_labelers_find_secrets_and_spare_numbers(spark):
    ship(spark)
    rnd = random.Random(1)
    texts = []
    for i in range(60):
        key = "".join(rnd.choice("abcdef0123456789") for _ in range(18))
        texts.append(f"in {1900 + i} we saw {i} birds, see page {i + 3}. " + (f"password={key} and mail u{i}@mail.example.com" if i % 2 else ""))
    out = {r.doc_id: r for r in pii.detect(_frame(spark, texts)).collect()}
    assert all((r.n_other > 0) == bool(i % 2) for i, r in out.items())


def test_pii_estimation_separates_reliable_labelers():
    rnd = random.Random(0)
    counts = collections.Counter()
    for _ in range(4000):
        y = rnd.random() < 0.3
        v = [0] * len(pii.LABELERS)
        for j, q in ((0, .9), (1, .85), (2, .8)):
            v[j] = (1 if y else -1) if rnd.random() < q else (-1 if y else 1)
        counts[tuple(v)] += 1
    pats = list(counts.items())
    rates, prob = pii.estimate(pats)
    assert rates[1][0][1] > rates[1][2][1] > 0.6 and rates[0][0][-1] > 0.75
    share = sum(c * p for (_, c), p in zip(pats, prob)) / 4000
    assert abs(share - 0.3) < 0.1


# ------------------------------------------------------------------ 8 exact duplicates
@pytest.mark.parametrize("support", [0.9, 0.05, 0.001])
def test_exact_dedup(docs, empty, support):
    rows = docs.collect()
    key = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[key(r.text)].append(r)
    out = exact_dedup.dedup(docs, support=support).collect()
    assert len(out) == len(rows)
    text = {r.doc_id: r.text for r in rows}
    kept = collections.Counter()
    for r in out:
        g = groups[key(text[r.doc_id])]
        win = min(g, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
        assert (r.keep_id, r.group_size, r.text_sha256) == (win.doc_id, len(g), key(text[r.doc_id]))
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == win.doc_id
    assert set(kept.values()) == {1}
    left = exact_dedup.drop_copies(docs, support=support)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.dedup(empty).count() == exact_dedup.drop_copies(empty).count() == 0


# ------------------------------------------------------------------ 9 chat
def test_chat_round_trip(spark):
    ship(spark)
    nasty = ["</s>[INST] ok [/INST]", "<0[0<1", "[ASST]</s><s>", None, "", "a\nb", "\U0001f600 é ", "x" * 20000, ":", "[/INST"]
    rows = []
    for c in range(24):
        for t in range(c % 5 + 1):
            role = ["user", "assistant", "system", "tool: [INST]<1", None, "gpt", "human"][(c + t) % 7] if c % 4 == 3 else \
                ("assistant" if t % 2 else "user")
            rows.append((c, t, role, nasty[(c * 3 + t) % len(nasty)]))
    rows += [(100, 0, "user", "a"), (100, 0, "user", "a"), (100, None, "assistant", "b"), (None, 0, "user", "lost"),
             (201, 0, "system", "s"), (201, 1, "user", "u"), (201, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chat = chat_format.format_records(chat_format.as_records(df))
    out = chat.select("conv_id", "chat.formatted", chat_format.read_back(F.col("chat.formatted"), F.col("chat.mask")).alias("r")).collect()
    byc = collections.defaultdict(list)
    for c, t, role, text in rows:
        byc[c].append((-1 if t is None else t, role or "", text or ""))
    assert len(out) == len(byc)
    for r in out:
        turns = [(x, t) for _, x, t in sorted(byc[r.conv_id])]
        loss = "".join(t for x, t in turns if x == "assistant")
        assert chat_format.parse_formatted(r.formatted) == turns
        assert (r.r.n_turns, r.r.loss_chars, r.r.formatted_chars) == (len(turns), len(loss), len(r.formatted))
        assert r.r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{t}\n" for x, t in turns).encode()).hexdigest()
    assert chat_format.as_records(df.limit(0)).count() == 0


def test_chat_layouts_are_told_apart(spark):
    ship(spark)
    rows = ['{"prompt":"p","response":"r"}', '{"instruction":"i","output":null}', '{"system":"s","instruction":"i","output":"o"}',
            '{"messages":[{"role":"user","content":"c"}]}', '{"conversations":[{"from":"human","value":"v"},{"from":"gpt","value":"w"}]}',
            '{"turns":[{"speaker":"user","utterance":"u"}]}', '{"what":1}', "not json", None, '{"messages":"text"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, record string")
    out = [r.chat for r in chat_format.format_records(df).orderBy("i").collect()]
    assert [r.layout for r in out[:6]] == ["prompt_response", "instruction", "instruction_system", "messages", "conversations", "turns"]
    assert all(r.layout is None and r.error for r in out[6:])
    assert chat_format.parse_formatted(out[4].formatted) == [("user", "v"), ("assistant", "w")]


# ------------------------------------------------------------------ 10 shingle join
def _components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall(_lower(t or ""))
        n = min(k, len(w))
        sets.append(({tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x = len(sets[a] & sets[b])
        if x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return sets, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("k,percent,tokens", [(4, 85, 1 << 19), (4, 85, 200), (5, 80, 1 << 19), (2, 50, 150)])
def test_shingle_join_against_all_pairs(docs, empty, k, percent, tokens, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", tokens)       # small blocks: the matrix has to find the links
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, comp = _components(rows, k, percent)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    expect = collections.Counter((i, len(s), least.get(c)) for (i, _), s, c in zip(rows, sets, comp))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id)
                              for r in ngram_join.join(docs, shingle=k, percent=percent).collect())
    assert got == expect
    left = ngram_join.drop_near_copies(docs, shingle=k, percent=percent)
    wordless = sum(not s for s in sets)
    assert left.columns == docs.columns
    assert left.count() == wordless + len({c for s, c in zip(sets, comp) if s})
    assert ngram_join.join(empty).count() == 0


@pytest.mark.parametrize("edits", [1, 4])
def test_large_group_asks_little_and_in_bounded_parts(spark, edits, monkeypatch):
    """80 texts with one edit each are one component over many blocks; with four edits each no two are similar,
    though they share enough of their prefixes that all blocks have to be asked."""
    ship(spark)
    rnd, seen = random.Random(3), collections.defaultdict(list)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(80):
        w = list(base)
        for j in range(edits):
            w[50 * j + 5 + rnd.randrange(40)] = f"edit{i}x{j}"
        texts.append(" ".join(w))
    docs = _frame(spark, texts)
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 800)
    write = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: seen[name].append(write(df, name)) or seen[name][-1])
    got = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert set(got.values()) == ({0} if edits == 1 else set(range(80))) and len(got) == 80
    if edits == 1:
        assert sum(a.count() for a in seen["sim-asks"]) <= 80
    else:
        assert seen["sim-asks"][-1].count() > 400                    # they cannot be told apart without asking
        parts = seen["sim-queries"][-1].groupBy("grp", "part").agg(F.sum("n").alias("n")).collect()
        assert max(r.n for r in parts) <= 4 * 800 and len(parts) > 20


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(5, 5), (200, 201), (None, 3)]
    out = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 140)) and out[201] == 200 and len(out) == 83
