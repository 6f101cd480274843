"""Scores, placements and whole queries against plain rewrites of what they should give."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.llm import language, packing, quality, queries, token_matrix, toxicity
from tesselon.llm.chat import digest
from tesselon.llm.tokens import codec
from tesselon.llm.words import one_array, words

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    "You Grobian! grobian, the fools are here; ÄRGER über naïve x_y 42 times",
    "a a a b " * 40 + "c",
    "",
    " \t\n",
    "line one\nline one\n  \nline two #hash <tag> 50% $5",
    "short",
    "Über-straße und und und joined\x0bword\x1cglued",
    "die das der " * 60 + "\n" + "die das der " * 60,
]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


# -- toxicity


def term_set(text):
    own = split(text)
    found = []
    for w in own:
        for run in re.findall(r"[^\W_]+", w.lower()):
            found.append(zlib.crc32(run.encode()))
            found += [zlib.crc32(f"{run[:n]}~".encode()) for n in (4, 5, 6, 7) if len(run) > n]
    times = Counter(found)
    out = set(times)
    for rate, mark in toxicity.LEVELS:
        out |= {t ^ mark for t, n in times.items() if n >= 2 and n >= rate * len(own)}
    return out


def test_toxicity_score_is_the_double_sum():
    rng = np.random.default_rng(3)
    every = sorted(set().union(*map(term_set, TEXTS)))
    active = np.array(every[::2], np.uint32)
    m = toxicity.FactorizationMachine(active, -0.7, rng.normal(0, 1, len(active)), rng.normal(0, 0.5, (len(active), toxicity.FACTORS)))
    got = m.score(words(one_array(pa.array(TEXTS))))
    assert [sorted(s.tolist()) for s in toxicity.term_sets(words(one_array(pa.array(TEXTS))))] == [sorted(term_set(t)) for t in TEXTS]
    for text, score in zip(TEXTS, got, strict=True):
        own = [k for k, t in enumerate(active.tolist()) if t in term_set(text)]
        z = m.bias + sum(m.weights[k] for k in own)
        z += sum(float(np.dot(m.factors[a], m.factors[b])) for x, a in enumerate(own) for b in own[x + 1 :])
        assert score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-9)


def test_toxicity_does_not_depend_on_file_splits(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    one, two = (toxicity.fit(d.select("doc_id", "text"), labels) for d in (docs, docs.repartition(7, "text")))
    assert (one.active == two.active).all() and np.allclose(one.weights, two.weights) and np.allclose(one.factors, two.factors)


def test_near_copies_leave_the_fit_however_many(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, toxicity.MINIMA).tolist()
    far = [[*base[: toxicity.BAND], *rng.integers(0, 1 << 32, toxicity.MINIMA - toxicity.BAND).tolist()] for _ in range(60)]  # one band alike
    near = [*base[:12], 1, 2, 3, 4]
    assert toxicity.without_copies([*far, base, near]) == list(range(61))


# -- language


def test_language_counts_and_scores(spark):
    counted = [("de", "und", 9), ("de", "straße", 4), ("en", "and", 9), ("en", "street", 3), ("en", "und", 1), ("fr", "et", 2), ("fr", "été", 5)]
    m = language.model_of(spark.createDataFrame(counted, "lang string, word string, n long"))
    langs = sorted({c[0] for c in counted})
    tables = {n: defaultdict(lambda: [0] * len(langs)) for n in (0, *language.LENGTHS)}
    for lang, word, n in counted:
        marked = f"^{word}$"
        for key, size in [(word, 0)] + [(marked[k : k + g], g) for g in language.LENGTHS for k in range(len(marked) - g + 1)]:
            tables[size][key][langs.index(lang)] += n

    def frequencies(size, key):
        total = [sum(v[x] for v in tables[size].values()) + 1 for x in range(len(langs))]
        return [math.log((tables[size][key][x] + 0.1) / (total[x] + 0.1 * len(tables[size]))) for x in range(len(langs))]

    def known(size, key):
        return key in tables[size] and sum(tables[size][key]) >= language.LEAST_SEEN

    def predict(text):
        runs = [r for w in split(text) for r in re.findall(r"[^\W\d_]+", w.lower())]
        if not runs:
            return "und", 0.0
        z = [0.0] * len(langs)
        for run in runs:
            hits = [frequencies(0, run)] if known(0, run) else []
            for g in language.LENGTHS:
                if not hits:
                    marked = f"^{run}$"
                    hits = [frequencies(g, marked[k : k + g]) for k in range(len(marked) - g + 1) if known(g, marked[k : k + g])]
            for x in range(len(langs)):
                z[x] += sum(h[x] for h in hits) / max(len(hits), 1) / len(runs)
        top = [math.exp((v - max(z)) * min(len(runs), language.SURE_AFTER)) for v in z]
        return langs[top.index(max(top))], max(top) / sum(top)

    texts = ["und", "Straßen und", "streets and été", "12 ?", "", "ét xyz", "中文 und", "and " * 50, "Et, tu: stra-und"]
    named, score = m.predict(words(one_array(pa.array(texts))))
    for text, lang, s in zip(texts, named, score, strict=True):
        want = predict(text)
        assert lang == want[0] and s == pytest.approx(want[1], rel=1e-4)
    assert len(m.words) == sum(known(0, k) for k in tables[0]) and all(len(m.grams[g]) == sum(known(g, k) for k in tables[g]) for g in language.LENGTHS)


def test_every_language_keeps_its_words(spark):
    many = [("big", f"w{k}", 1000) for k in range(3000)] + [("small", f"v{k}", 3) for k in range(50)]
    m = language.model_of(spark.createDataFrame(many, "lang string, word string, n long"))
    assert all(f"v{k}" in m.words for k in range(50)) and m.predict(words(pa.array(["v7 v9"])))[0] == ["small"]


# -- packing


def test_cost_balance_is_the_stated_rule():
    rng = np.random.default_rng(5)
    for _ in range(60):
        cap, q = 64, 1 / 64
        lengths = rng.integers(1, rng.integers(2, 200), rng.integers(1, 50))
        pieces, used = packing.spread(lengths, cap, q)
        want, rest, at = [], [], 0
        for d, n in enumerate(lengths.tolist()):
            for s in range(0, n - n % cap, cap):
                want.append((d, s, cap, at, 0))
                at += 1
            if n % cap:
                rest.append([n % cap, d, n - n % cap])
        rest.sort(key=lambda r: (-r[0], r[1]))
        full = sum(r[0] for r in rest) // cap
        bins = [{"room": cap, "cost": 0.0} for _ in range(full)]
        over = []
        for n, d, s in rest:
            while n:
                fits = [k for k in range(full) if bins[k]["room"] >= n]
                if fits:
                    k, part = min(fits, key=lambda k: (bins[k]["cost"], k)), n
                else:  # cut to fill the largest room
                    k = max(range(full), key=lambda k: (bins[k]["room"], -k), default=None)
                    part = bins[k]["room"] if full else 0
                    if not part:
                        over.append((n, d, s))
                        break
                want.append((d, s, part, at + k, cap - bins[k]["room"]))
                bins[k]["room"] -= part
                bins[k]["cost"] += part + q * part * part
                n, s = n - part, s + part
        assert pieces[: len(want)] == want and sum(p[2] for p in pieces[len(want) :]) == sum(o[0] for o in over) < cap
        sizes = Counter()
        for p in pieces[len(want) :]:
            sizes[p[3]] += p[2]
        left = sum(o[0] for o in over)
        assert sorted(sizes.values(), reverse=True) == [1 << b for b in range(12, -1, -1) if left >> b & 1] and used == at + full + len(sizes)


def test_best_fit_takes_the_least_room_each_time():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = rng.integers(1, 150, 50)
        pieces, used = token_matrix.best_fit(lengths, 64)
        assert [p[2] for p in pieces] == sorted((p[2] for p in pieces), reverse=True)
        room = {}
        for _, _, n, sequence, offset in pieces:
            fits = [r for r in room.values() if r >= n]
            if fits:
                assert room[sequence] == min(fits) == 64 - offset
            else:
                assert sequence == len(room) and offset == 0
            room[sequence] = room.get(sequence, 64) - n
        assert len(room) == used


def test_written_matrix_reads_back(spark, tmp_path):
    made = token_matrix.token_matrix(spark.read.parquet(f"{SMALL}/documents.parquet").limit(40), "word_bpe_49k.json", 2)
    token_matrix.write_token_matrix(made, str(tmp_path / "m"))
    key = lambda r: r["sequence_id"]
    assert sorted(spark.read.parquet(str(tmp_path / "m")).collect(), key=key) == sorted(made.collect(), key=key)


# -- quality


def test_quality_score_is_its_features():
    texts = one_array(pa.array(TEXTS))
    rng = np.random.default_rng(8)
    m = quality.QualityModel(rng.normal(0, 1, quality.SPACES << quality.BITS), 0.3, 1.7, -0.4)
    mask, low = (1 << 64) - 1, (1 << quality.BITS) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def features(text):
        own = [zlib.crc32(w.encode()) for w in split(text)]
        one = Counter(mix(h) & low for h in own)
        pairs = [(1 << 32) if a == b else (a << 32) | b for a, b in zip(own, own[1:], strict=False)]
        two = Counter((mix(p) & low) + (1 << quality.BITS) for p in pairs)
        raw = text.encode()
        grams = [int.from_bytes(raw[k : k + 4], "little") for k in range(len(raw) - 3)]
        three = Counter(((g * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.BITS)) + (2 << quality.BITS) for g in grams)
        return {b: quality.SCALE * n / sum(part.values()) for part in (one, two, three) for b, n in part.items()}

    got = quality.features_of(texts, words(texts))
    for text, (bucket, value), p in zip(TEXTS, got, m.score(texts, words(texts)), strict=True):
        want = features(text)
        assert dict(zip(bucket.tolist(), value.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
        z = 1.7 * (0.3 + sum(m.weights[b] * v for b, v in want.items())) - 0.4
        assert p == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-6)


def test_quality_is_calibrated_and_learns_from_its_fold_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    spoiled = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(docs, x) for x in (labels, spoiled))
    assert (one.weights == two.weights).all() and (one.bias, one.scale, one.shift) == (two.bias, two.scale, two.shift)
    found = docs.withColumn("q", quality.judged(one, F.col("text"))).join(labels, "doc_id").select("doc_id", "quality", "q.*").collect()
    own = [(r.probability, r.quality) for r in found if held(r.doc_id) and not r.base_failed]
    assert sum((p - y) ** 2 for p, y in own) / len(own) < 0.05 and abs(sum(p - y for p, y in own)) / len(own) < 0.05


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    seen = []
    real = quality.QualityModel.fit
    monkeypatch.setattr(quality, "FIT_BYTES", 60_000)
    monkeypatch.setattr(quality.QualityModel, "fit", staticmethod(lambda features, *rest: seen.append(features) or real(features, *rest)))
    quality.fit(docs, labels)
    sizes = sum(a.nbytes + b.nbytes for a, b in seen[0])
    assert 20_000 < sizes <= 120_000


# -- the queries' contracts

LONGS = "bigint"
CONTRACTS = {
    "op1_toxicity": {"doc_id": LONGS, "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_exact_dedup": {"doc_id": LONGS, "keep_id": LONGS, "group_size": LONGS, "kept": "boolean", "text_sha256": "string"},
    "op4_language": {"doc_id": LONGS, "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_balanced_packing": dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), LONGS),
    "op7_quality": dict.fromkeys(("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), LONGS) | {"base_failed": "boolean", "kept": "boolean"},
    "op8_secrets": dict.fromkeys(("doc_id", "n_assign", "n_access", "n_hex"), LONGS) | {"base_sha256": "string", "spans": "string"},
    "op9_chat_format": dict.fromkeys(("conv_id", "n_turns", "loss_chars", "formatted_chars"), LONGS) | {"turns_sha256": "string", "loss_sha256": "string"},
    "op10_ngram_jaccard": dict.fromkeys(("doc_id", "n_shingles", "component_id"), LONGS),
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def run(name):
        if name not in found:
            df = queries.queries()[name](spark, SMALL)
            found[name] = (dict(df.dtypes), df.collect())
        return found[name]

    return run


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract_columns(results, documents, name):
    types, rows = results(name)
    assert {k: types.get(k) for k in CONTRACTS[name]} == CONTRACTS[name]
    if name not in ("op5_balanced_packing", "op9_chat_format"):
        assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r.held_out == held(r.doc_id) for r in rows if "held_out" in types)
    assert all(0 <= r.score <= 1 for r in rows if "score" in types)


def test_op1_op4_decide_by_score(results, documents):
    assert all(r.predicted == (r.score >= 0.7) for r in results("op1_toxicity")[1])
    known = {r.lang for r in documents.values() if r.lang is not None}
    for r in results("op4_language")[1]:
        letters = any(c.isalpha() for c in documents[r.doc_id].text or "")
        assert (r.lang_pred in known) if letters else (r.lang_pred == "und")


def test_op5_holds_every_id(results, documents):
    tok = codec("word_bpe_49k.json").tokenizer
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in results("op5_balanced_packing")[1]:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(documents)
    for doc_id, pieces in by_doc.items():
        ids = np.array([*tok.encode(documents[doc_id].text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for held_ in by_sequence.values():
        at = 0
        for offset, length in sorted(held_):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_op7_counts(results, documents):
    for r in results("op7_quality")[1]:
        text = documents[r.doc_id].text or ""
        own = split(text)
        lines = [line for line in text.split("\n") if split(line)]
        windows = Counter(zip(own, own[1:], own[2:], strict=False))
        repeated = {k + j for k in range(len(own) - 2) if windows[tuple(own[k : k + 3])] > 1 for j in range(3)}
        want = (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r["kept"])


def test_op8_base_spans(results, documents):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in results("op8_secrets")[1]:
        text = documents[r.doc_id].text or ""
        spans = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))
        kinds = Counter(s[2] for s in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        shown = [f"{k}:{a}:{b}" for a, b, k in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess:")] == shown


def components(texts, size, num, den):
    sets = {}
    for i, text in texts.items():
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    names = sorted(sets)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            if sets[a] and sets[b] and num * max(len(sets[a]), len(sets[b])) <= den * min(len(sets[a]), len(sets[b])):
                same = len(sets[a] & sets[b])
                if den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op10_components(results, documents):
    want = components({i: r.text for i, r in documents.items()}, 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in results("op10_ngram_jaccard")[1]} == want


def test_op9_reads_back(spark, results):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(k, *t[2:]) for k, t in enumerate(queries.TRAP)]
    found = {r.conv_id: r for r in results("op9_chat_format")[1]}
    assert set(found) == set(turns) and callable(digest)
    for conv, own in turns.items():
        own.sort()
        r, loss = found[conv], "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# -- the pipeline


@pytest.fixture(scope="module")
def odd(spark):
    docs = [(1, None, "en", "src00", 0), (2, "", None, None, 0), (3, "  \n", "de", "src10", 3), (4, "same words here for all", "en", "src00", 5), (4, "same words here for all", "en", "src00", 5)]
    docs += [(5, "same words here for all", "en", "src01", 5), (None, "same words here for all", "en", "src01", 5), (6, "long " * 30_000, "fr", "src11", 9), (7, " ".join(f"w{k}" for k in range(60)), "en", "src00", 9)]
    docs += [(8, " ".join(f"w{k}" for k in range(60)) + " more", "en", "src00", 9), (None, "nobody's own text", None, "src00", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("mine").alias(c) for c in ("kept", "score", "mix", "node", "row", "label", "dedup")])


def test_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    none = odd.filter("false")
    for name in ("toxicity", "exact_dedup", "ngram_jaccard", "mixing"):
        assert stages[name](spark, none, SMALL).count() == 0
        assert stages[name](spark, odd, SMALL).columns == odd.columns
    assert stages["toxicity"](spark, odd, SMALL).count() == odd.count()
    exact = sorted(((r.doc_id, r.text) for r in stages["exact_dedup"](spark, odd, SMALL).collect()), key=str)
    assert len(exact) == 7 and (4, "same words here for all") in exact and (1, None) in exact and (2, "") not in exact
    near = stages["ngram_jaccard"](spark, odd, SMALL).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in near) == [(0, "nobody's "), (1, ""), (2, ""), (3, "  \n"), (4, "same word"), (4, "same word"), (6, "long long"), (7, "w0 w1 w2 ")]
    mixed = Counter((r.doc_id, r.text) for r in stages["mixing"](spark, odd, SMALL).collect())
    assert not mixed - Counter((r.doc_id, r.text) for r in odd.collect())
    packed = stages["packing"](spark, odd, SMALL)
    assert packed.count() >= odd.count() and stages["packing"](spark, none, SMALL).count() == 0
    assert packed.filter("text is not null").count() if "text" in packed.columns else True


def test_pipeline_is_its_stages_by_brute_force(spark, documents):
    """run() against plain rewrites of each stage on all rows that the one before kept."""
    import corpus_pipeline as p

    model = toxicity.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    ids = sorted(documents)
    score = model.score(words(one_array(pa.array([documents[i].text for i in ids]))))
    left = {i: documents[i] for i, s in zip(ids, score, strict=True) if s < toxicity.THRESHOLD}
    first = {}
    for i in sorted(left):
        first.setdefault(left[i].text or "", i)
    left = {i: left[i] for i in first.values()}
    near = components({i: r.text for i, r in left.items()}, 5, 80, 100)
    left = {i: r for i, r in left.items() if near[i][1] == i}

    tokens = {i: -(-len(r.text or "") // 4) for i, r in left.items()}
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for i, r in left.items():
        tree[(r.source or "")[:4]][r.lang or ""][r.source or ""].append(i)

    def supply(node):
        return sum(tokens[i] for i in node) if isinstance(node, list) else sum(map(supply, node.values()))

    def dealt(children, pool, weight):
        open_, got = set(children), {}
        while open_:
            total = sum(weight(c) for c in open_)
            full = {c for c in open_ if supply(children[c]) * total <= pool * weight(c)}
            if not full:
                return got | {c: pool * weight(c) / total for c in open_}
            got |= {c: supply(children[c]) for c in full}
            pool -= sum(supply(children[c]) for c in full)
            open_ -= full
        return got

    kept = set()
    for domain, pool in dealt(tree, p.MIX_SHARE * supply(tree), lambda c: p.MIX_WEIGHTS["domain"].get(c, 1)).items():
        for lang, own in dealt(tree[domain], pool, lambda c: p.MIX_WEIGHTS["language"].get(c, 1)).items():
            for source, take in dealt(tree[domain][lang], own, lambda c: 1).items():
                leaf = tree[domain][lang][source]
                budget, place = math.floor(take + 1e-6), lambda i, e: hashlib.md5(f"{p.MIX_SEED}:{e}:{i}".encode()).hexdigest()
                whole = budget >= supply(leaf) > 0
                at = 0
                for i in sorted(leaf, key=lambda i: place(i, 0)):
                    at += tokens[i]
                    if whole or at <= budget:
                        kept.add(i)
    rows = p.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == kept and len(kept) > 50
    tok = codec(p.TOKENIZER).tokenizer
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    for i in kept:
        want = np.array([*tok.encode(documents[i].text or "", add_special_tokens=False).ids, p.END_ID], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(parts[i])) == want
