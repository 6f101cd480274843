"""The operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselon.llm import components as cc
from tesselon.llm import hot_groups, jaccard, language, mixing, packing, quality, secrets, token_matrix, toxicity
from tesselon.llm.chat import digest, format_chat
from tesselon.llm.exact_dedup import drop_exact_copies, exact_dedup
from tesselon.llm.jaccard import Likeness, jaccard_join
from tesselon.llm.queries import TRAP
from tesselon.llm.tokens import codec, tokenizer_path
from tesselon.llm.words import one_array, words

TOKENIZER = "word_bpe_49k.json"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Hello, wörld"), (4, "Hello, wörld"), (5, "hello, wörld"), (6, "x " * 30000), (None, "Hello, wörld")]


@pytest.fixture(scope="module")
def odd(spark):
    """Every edge case, and columns whose names operators might use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumn("kept", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("node", F.lit("mine")).withColumn("label", F.lit("mine")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- exact dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("n", [1, 5])
def test_exact_dedup(spark, odd, none, keep, n):
    many = [(k, "same text" if k % 3 else f"own {k % 40}") for k in range(600)]
    for df in (odd, spark.createDataFrame(many, "doc_id long, text string").repartition(4)):
        found = exact_dedup(df, keep=keep, n_buckets=n).select("doc_id", "text", "dedup.*").collect()
        groups = {}
        for r in df.select("doc_id", "text").collect():
            groups.setdefault(r.text or "", []).append(r.doc_id)
        assert len(found) == df.count()
        pick = max if keep == "largest" else min
        for r in found:
            own = groups[r.text or ""]
            assert r.group_size == len(own) and r.keep_id == pick([i for i in own if i is not None], default=None)
            assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        for text, own in groups.items():
            stays = [r for r in found if (r.text or "") == text and r["kept"]]
            assert len(stays) == 1 and stays[0].doc_id == stays[0].keep_id
    assert drop_exact_copies(odd).columns == odd.columns and drop_exact_copies(none).count() == 0


def test_exact_dedup_cuts_a_hot_group(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), "id")).otherwise("hot").alias("text"))
    plan = exact_dedup(df, n_buckets=8).withColumn("pid", F.spark_partition_id())
    sizes = [r["count"] for r in plan.filter("text = 'hot'").groupBy("pid").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 1500
    assert rows(plan.filter("text = 'hot' and dedup.kept").select("doc_id", "dedup.group_size")) == [(1, 2666)]


# -- mixing


def test_mixing(spark, odd, none):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd"), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 4)).alias("source"), F.when(F.col("id") % 5 == 0, "de").otherwise("en").alias("lang"))
    weights = {"domain": {"a": 1, "b": 3}, "language": {"en": 2}}
    mixed = mixing.mix(df, F.substring("source", 1, 1), F.col("lang"), F.col("source"), weights, 0.7, 2, 3).select("doc_id", "mix.*").collect()
    tokens = {r.doc_id: r.doc_id % 7 + 1 for r in df.collect()}
    total = sum(tokens.values())
    by_domain = Counter()
    for r in mixed:
        assert r.tokens == tokens[r.doc_id] and r.epoch in (0, 1)
        by_domain[r.domain] += r.tokens
    assert abs(by_domain["a"] - 0.7 * total / 4) < 40 and abs(by_domain["b"] - 0.7 * total * 3 / 4) < 80
    per = Counter((r.doc_id, r.epoch) for r in mixed)
    assert max(per.values()) == 1
    first = {r.doc_id for r in mixed if r.epoch == 0}
    assert all(r.doc_id in first for r in mixed if r.epoch == 1)
    for df_ in (odd, none):
        out = mixing.mix(df_, F.substring("source", 1, 1), F.col("lang"), F.col("source"), weights, 1.0, 1, 3)
        assert out.columns == [*df_.columns, "mix"]
    assert mixing.mix(odd, F.lit("d"), F.col("lang"), F.col("source"), {}, 1.0).count() == odd.count()


def test_leaf_of_empty_texts_is_taken(spark):
    df = spark.createDataFrame([(k, t, "en", s) for k, (t, s) in enumerate([("", "a"), (None, "a"), ("", "a"), ("abcd" * 9, "b"), ("abcd" * 9, "b")])], "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(df, F.lit("d"), F.col("lang"), F.col("source"), {}, 0.5, 2)
    assert sorted((r.doc_id, r.mix.epoch) for r in mixed.filter("source = 'a'").collect()) == [(0, 0), (1, 0), (2, 0)]
    assert mixed.filter("source = 'b'").count() == 1


@pytest.mark.parametrize(("share", "epochs"), [(1.0, 1), (0.5, 1), (0.8, 2), (2.0, 2)])
def test_rows_without_tokens(spark, share, epochs):
    texts = ["abcd" * 9] * 20 + [""] * 40
    df = spark.createDataFrame([(k, t, "en", "ab"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(df, F.lit("d"), F.col("lang"), F.col("source"), {}, share, epochs).select("doc_id", "mix.*").collect()
    times = Counter((r.doc_id, r.epoch) for r in mixed)
    assert max(times.values()) == 1 and {r.epoch for r in mixed} <= set(range(epochs))
    taken = sum(r.tokens for r in mixed)
    assert taken <= share * 20 * 9 and taken >= min(share, epochs) * 20 * 9 - 18
    if share >= epochs:
        assert len(mixed) == 60 * epochs


def test_mixing_is_its_sql_on_empty_texts(spark, tmp_path):
    """The registered query and its SQL on a table with leaves of empty texts and rows without tokens."""
    import duckdb

    from tesselon.llm.oracle import SQL
    from tesselon.llm.queries import op6_mixing

    sizes = [0, 0, 3, 8, 0, 17]
    docs = [(k, "x" * sizes[k % 6] if k % 7 else None, ["en", "de", "fr", None][k % 4], ["src00", "src10", "src11", None][k // 7 % 4]) for k in range(400)]
    docs += [(1000 + k, "", "it", "src20") for k in range(9)] + [(3, "y" * 9, "en", "src00"), (None, "z", "en", "src00")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = con.execute(SQL["op6_mixing"]).fetchall()
    got = op6_mixing(spark, str(tmp_path)).select("doc_id", "epoch", "domain", "language", "source", "tokens").collect()
    assert Counter(map(tuple, got)) == Counter(wanted) and sum(r.source == "src20" for r in got) == 9


def test_shortages_go_to_siblings_first(spark):
    leaves = [("d1", "en", "s1", 1, 10), ("d1", "en", "s2", 1, 100), ("d1", "fr", "s1", 1, 100), ("d2", "en", "s1", 1, 50)]
    df = spark.createDataFrame(leaves, "domain string, language string, source string, rows long, tokens long")
    take = {(r.domain, r.language, r.source): r.take for r in mixing.budgets(df, F.lit(0.5), {}, 1).collect()}
    # 130 tokens: d2 gives its 50, d1 80; both languages 40; s1 only has 10, so s2 gives 30.
    assert take == {("d1", "en", "s1"): 10, ("d1", "en", "s2"): 30, ("d1", "fr", "s1"): 40, ("d2", "en", "s1"): 50}


# -- tokens and packing


def test_codec_is_the_tokenizer():
    c = codec(TOKENIZER)
    rng = np.random.default_rng(4)
    letters = list("aB'’sS \t\n\x1c\xa0<|>éÉßẞΣσςİi̇1٣½…—#$́​中あ😀×÷ÿŸ\x85 !")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "it's we'll 'S 'LL !'s don't", ""]
    ids, starts = c.encode(pa.array(texts))
    want = c.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert c.by_word and all(ids[a:b].tolist() == e.ids for a, b, e in zip(starts, starts[1:], want, strict=False))
    other = codec("byte_bpe_50k.json")
    ids, starts = other.encode(pa.array(texts[:50]))
    assert not other.by_word and ids[starts[3] : starts[4]].tolist() == other.tokenizer.encode(texts[3], add_special_tokens=False).ids


@pytest.mark.parametrize("pack", [packing.spread, token_matrix.best_fit])
def test_packing_holds_every_token_once(pack):
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, rng.integers(2, 300), rng.integers(0, 60))
        pieces, used = pack(lengths, 64)
        seen = [np.zeros(n, int) for n in lengths]
        places = {}
        for d, start, n, sequence, offset in pieces:
            seen[d][start : start + n] += 1
            places.setdefault(sequence, []).append((offset, n))
        assert all((s == 1).all() for s in seen) and set(places) == set(range(used))
        for held in places.values():
            end = 0
            for offset, n in sorted(held):
                assert offset == end
                end += n
            assert end <= 64
            assert pack is not packing.spread or end & (end - 1) == 0


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(100):
        lengths = rng.integers(1, 150, 50)
        parts = sorted(((min(64, n - s), d, s) for d, n in enumerate(lengths.tolist()) for s in range(0, n, 64)), key=lambda p: (-p[0], p[1], p[2]))
        rooms = []
        for n, _, _ in parts:
            fits = [r for r in rooms if r[0] >= n]
            best = min(fits, key=lambda r: r[0]) if fits else [64]
            if not fits:
                rooms.append(best)
            best[0] -= n
        assert token_matrix.best_fit(lengths, 64)[1] == len(rooms)


def test_pack_and_matrix(spark, odd, none):
    tok = codec(TOKENIZER).tokenizer
    want = Counter()
    for _, text in ODD:
        want[tuple([*tok.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    found = packing.pack(odd, TOKENIZER, 2, window=5000).orderBy("sequence_id", "offset").collect()
    assert sum(r.length for r in found) == sum(len(k) * n for k, n in want.items())
    whole = Counter(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in found if r.length == r.doc_tokens)
    assert whole[(2,)] == 3 and all(whole[k] <= n for k, n in want.items())
    long = sorted((r.start, r.ids) for r in found if r.doc_id == 6)
    assert np.frombuffer(b"".join(bytes(i) for _, i in long), "<u4").tolist() == next(list(k) for k in want if len(k) > 20000)
    rows_ = token_matrix.token_matrix(odd, TOKENIZER, 2, window=5000).collect()
    assert sum(r.n_tokens for r in rows_) == sum(len(k) * n for k, n in want.items())
    for r in rows_:
        ids, place = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(place) == 4096 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 0).all()
        assert all(place[a:b].tolist() == list(range(b - a)) for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False))
    assert packing.pack(none, TOKENIZER, 2).count() == token_matrix.token_matrix(none, TOKENIZER, 2).count() == 0
    assert packing.pack(odd, tokenizer_path(TOKENIZER), 2).count() > 0


# -- learned operators


def sentences(spark, sf="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity(spark, odd, labels, none):
    docs, own = sentences(spark, "/root/testdata/sf0.1")
    found = toxicity.toxicity(docs.select("doc_id", "text"), own).select("doc_id", "toxicity.*")
    truth = {r.doc_id: r.toxic for r in own.collect()}
    found = [(r.predicted, truth[r.doc_id], zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.collect() if r.doc_id in truth]
    # Some toxic labels of sf0.1 lie on texts that share no term with other toxic ones.
    for fold, least in ((True, 0.87), (False, 0.93)):
        got = [(p, t) for p, t, held in found if held == fold]
        assert sum(p for p, t in got if t == 0) == 0 and sum(p for p, t in got if t == 1) >= least * sum(t for _, t in got)
    out = toxicity.toxicity(odd, labels)
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "toxicity"] and out.filter("toxicity.score is null or toxicity.score not between 0 and 1").isEmpty()
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(odd, labels.filter("false")).filter("toxicity.predicted = 1").isEmpty()


def test_a_marker_of_all_toxic_rows_counts(spark):
    rng = np.random.default_rng(6)
    own = [(k, int(k % 3 == 0)) for k in range(600)]
    texts = [(k, " ".join([*(f"word{w}" for w in rng.integers(0, 3000, 12)), *["grobian"] * t])) for k, t in own]
    model = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(own, "doc_id long, toxic int"))
    score = model.score(words(pa.array(["you grobian there", "nothing of that"])))
    assert score[0] > toxicity.THRESHOLD > score[1]


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    active = np.array([1, 2, 3, 4], np.uint32)
    sets, y = [], []
    for _ in range(4000):
        have = [t for t in (1, 2, 3, 4) if rng.random() < 0.5]
        sets.append(np.array(have, np.int64))
        y.append(int(1 in have and 2 in have))  # an insult and a group, neither alone
    m = toxicity.FactorizationMachine.fit(active.astype(np.uint32), sets, np.array(y))

    def score(*have):
        z = m.bias + sum(m.weights[t - 1] for t in have)
        return z + sum(float(m.factors[a - 1] @ m.factors[b - 1]) for a in have for b in have if a < b)

    assert score(1, 2) > 0 > max(score(1), score(2), score(3, 4), score(1, 3), score(2, 4))
    assert m.factors[0] @ m.factors[1] > 1


def test_language(spark, odd, none):
    docs, _ = sentences(spark)
    found = language.identify(docs.select("doc_id", "text", "lang")).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.language.lang == r.lang for r in held) >= 0.97 * len(held)
    out = language.identify(odd)
    assert {r.language.lang for r in out.collect()} == {"und"} and out.count() == len(ODD) and language.identify(none).count() == 0
    m = language.model_of(spark.createDataFrame([("de", "und", 9), ("de", "straße", 4), ("en", "and", 9), ("en", "street", 4)], "lang string, word string, n long"))
    texts = pa.array(["und und", "straßen", "streets and", "12 !?", "中文", ""])
    named, score = m.predict(words(one_array(texts)))
    assert named[:4] == ["de", "de", "en", "und"] and named[4] == "de" and named[5] == "und" and score[4] == 0.5 and ((score >= 0) & (score <= 1)).all()


def test_quality(spark, odd, labels, none):
    docs, own = sentences(spark)
    found = quality.quality(docs.select("doc_id", "text"), own).select("doc_id", "text", "quality.*").collect()
    truth = {r.doc_id: r.quality for r in own.collect()}
    got = [(r.kept, truth[r.doc_id]) for r in found if r.doc_id in truth and not r.base_failed]
    assert np.mean([k == (t == 1) for k, t in got]) > 0.97
    extra = quality.quality(odd, labels).select("doc_id", "text", "quality.*").collect()
    for r in found[:200] + extra:
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, twice = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                twice += line in seen
                seen.add(line)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(none, labels).count() == 0 and quality.quality(odd, labels).columns == [*odd.columns, "quality"]


# -- secrets

KEY = "AKIA" + "ABCDEFGHIJ012345"
SECRETS = [
    'password = "hunter2x"', "API_KEY: abcdef token:xyz", "secret: token: abcdefg", "toKen = ſecret passworKd = abcdef9", f"é {KEY} {KEY[:-1]}", "ab" * 12 + "g" + "0" * 23, "é" * 3 + " passwd='Xk9#vQ2!mZ7p' ok",
    "pwd is qwerty123", "pass -> 2019-05-04", None, "", "token=token=abcdefgh api_key=aaaaaaaaaaaa", "AKIAAKIA" + "A" * 11 + " deadbeefdeadbeefdeadbeef",
]


def test_secrets(spark, none):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(SECRETS)], "doc_id long, text string").withColumn("spans", F.lit(1))
    key = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")) + ")"
    assign = re.compile(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.find_secrets(df).select("text", "secrets.*").collect():
        text = r.text or ""
        want = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(want)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
    spans = {r.doc_id: r.secrets.spans for r in secrets.find_secrets(df).collect()}
    assert "guess" in spans[6] and "guess" not in spans[7] and "guess" not in spans[8]
    at = [tuple(map(int, s.split(":")[1:])) for s in spans[6].split(",") if s.startswith("guess")][0]
    assert SECRETS[6][at[0] : at[1]] == "Xk9#vQ2!mZ7p'"[:-1]
    assert secrets.find_secrets(none).count() == 0


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("DB_PASSWORD=Xk9#vQ2!mZ7p", "Xk9#vQ2!mZ7p"),
        ("userPassword: Xk9#vQ2!mZ7p", "Xk9#vQ2!mZ7p"),
        ("client_secret: 'Q!9z$Lk2#v'", "Q!9z$Lk2#v"),
        ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEX", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEX"),
        ("dbpass=Xk9#vQ2!mZ7p", "Xk9#vQ2!mZ7p"),
        ("author: DB_PASSWORD=Xk9#vQ2!mZ7p", "Xk9#vQ2!mZ7p"),
        ("author: Shakespeare, opinion is important, shopping: groceries", None),
    ],
)
def test_credential_words_in_identifiers(text, value):
    found = [text.encode()[a:b].decode() for a, b, kind in secrets.scan(text.encode()) if kind == "guess"]
    assert found == ([] if value is None else [value])


def test_contexts_take_linear_time():
    for text in ("pass" * 50_000, "pass:" * 50_000, "a" * 200_000 + "pass", "pass=" + "pass " * 50_000):
        secrets.scan(text.encode())


def test_guess_costs():
    cost = secrets.guess_cost
    assert cost("password") < cost("Password") < cost("p@ssword1") < cost("Xk9#vQ2!mZ7p")
    assert cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("20190504") < 5 and cost("correcthorse") > cost("passwordhello")
    assert cost("x" * 100_000) < 8 and cost("") == 0


def every_segmentation(value):
    """The cost by trying every part, copies in any number included."""
    low, plain = value.lower(), value.lower().translate(secrets.LEET)
    walks = [lambda i: low[i] in secrets.NEXT.get(low[i - 1], ()), lambda i: low[i] in secrets.BELOW.get(low[i - 1], ())]
    size_of = lambda i: np.log10(secrets._alphabet(value[i]))
    best = [0.0]
    for k in range(1, len(value) + 1):
        costs = [best[k - 1] + size_of(k - 1)]
        for a in range(k - 2):
            part = value[a:k]
            costs += [best[a] + size_of(a) + 1.0 + np.log10(k - a) + 0.3 for w in walks if all(w(i) for i in range(a + 1, k))]
            if rank := secrets.RANK.get(plain[a:k]):
                turned = 0.0 if part.islower() or not part.isalpha() else 0.3 if part.istitle() or part.isupper() else 1.0
                costs.append(best[a] + np.log10(rank + 1) + turned + 0.5 * (low[a:k] != plain[a:k]) + 0.3)
            if secrets.DATE.fullmatch(part):
                costs.append(best[a] + 4.3)
        for p in range(1, min(secrets.LONGEST_BLOCK, k // 2) + 1):
            for a in range(k - p, p - 1, -p):
                if value[a:k] != value[a - p : a] * ((k - a) // p):
                    break
                if p == 1 and k - a == 1:
                    continue
                costs.append(best[a] + np.log10(p) + 0.8 + np.log10((k - a) // p + 1))
        best.append(min(costs))
    return best[-1]


def test_guess_cost_is_the_least():
    cost = secrets.guess_cost
    assert abs(cost("passwordefghij") - 4.09) < 0.01 and max(map(cost, ("1qaz2wsx", "abcxabcxabcx", "zse4xdr5", "Xk9Xk9Xk9Xk9"))) < 8
    assert min(map(cost, ("Xk9#vQ2!mZ7p", "Q!9z$Lk2#v"))) > 8
    rng = np.random.default_rng(3)
    parts = ["password", "test", "love", "efgh", "rty", "1qaz", "aaa", "111", "2019", "0504", "ab", "x", "Q", "#", "7"]
    for n in range(300):
        value = "".join(rng.choice(parts[: 3 + n % 13], rng.integers(1, 7))) * int(rng.integers(1, 4))
        assert cost(value) == pytest.approx(every_segmentation(value)), value
    assert cost("Zaphodbeeblebrox") > 8 > cost("Zaphodbeeblebrox", secrets.ranked(["zaphod", "beeblebrox"]))
    for value in ("ab" * 5_000, "password1" * 500, "aab" * 2_000):
        assert cost(value) < 12


# -- chat


def test_chat(spark, none):
    convs = [(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "a\\b<#:>"), (1, 3, "user", "more"), (1, 4, "assistant", None), (1, 5, "user", "bye"), (2, 0, "user", None), (3, None, None, "x"), (3, 1, "assistant", "y"), (3, 1, "assistant", "y"), *TRAP]
    df = spark.createDataFrame(convs, "conv_id long, turn int, role string, text string").withColumn("example", F.lit("mine"))
    examples = format_chat(df).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.n_turns, r.loss_start is None) for r in examples] == [(-7, 2, False), (1, 3, False), (1, 5, False), (1, 6, True), (2, 1, True), (3, 2, False), (3, 3, False)]
    own = [r for r in examples if r.conv_id == 1]
    assert own[1].formatted.startswith(own[0].formatted) and own[0].formatted[own[0].loss_start : own[0].loss_end] == "a\\bb\\l\\h\\c>"
    found = {r.conv_id: r for r in digest(format_chat(df)).collect()}
    for conv in {c[0] for c in convs}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in convs if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = found[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(e.formatted) for e in examples if e.conv_id == conv)
    assert format_chat(df.filter("false")).count() == 0


# -- Jaccard join


def brute(docs, like):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = like.words
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    names = sorted(sets)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and like.den * same >= like.num * (len(sets[a]) + len(sets[b]) - same):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(seed, n):
    """Texts around the threshold: bases of many sizes with some words changed, dropped or added."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = list(rng.choice(vocabulary, 30))
    bases = [list(rng.choice(vocabulary, rng.integers(1, 160))) for _ in range(12)]
    out = []
    for k in range(n):
        w = list(bases[rng.integers(len(bases))])
        for _ in range(rng.integers(0, 1 + len(w) // 25)):
            at = rng.integers(len(w) + 1)
            kind = rng.integers(3)
            w[at : at + (kind != 0)] = [] if kind == 1 else [str(rng.choice(vocabulary))]
        if rng.random() < 0.2:
            w += passage
        out.append((k, " ".join(w) if rng.random() < 0.9 else " ".join(w).upper() + "\n"))
    return out


@pytest.mark.parametrize("like", [Likeness(3, 90, 100), Likeness(5, 80, 100), Likeness(1, 60, 100)])
def test_jaccard_join_is_exact(spark, like, monkeypatch):
    docs = variants(7, 260)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, like)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, like).collect()}
    assert got == want and len({c for _, c in want.values()}) < 250
    for name, value in (("CHUNK_NODES", 5), ("CHUNK_DOCS", 4), ("BUNDLE_ROWS", 50), ("BUNDLE_SHINGLES", 500), ("BROADCAST_ROWS", 0), ("MATRIX", 6), ("FEW", 3), ("HOT_SAMPLE", 1), ("HOT_SEEN", 3)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(hot_groups, "HUBS", 1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, like).collect()} == want


def star(n, spare):
    """A base, copies that differ from it in a place of their own (mostly not linked with each other), and ``spare`` far ones."""
    base = [f"w{k}" for k in range(120)]
    out = [(0, " ".join(base))]
    for k in range(1, n):
        w = list(base)
        w[3 + k % 110] = f"own{k}"
        out.append((k, " ".join(w)))
    for k in range(n, n + spare):  # alike enough to share tiles, too far to be linked
        w = list(base)
        for at in range(4, 40, 3):
            w[at] = f"far{k}"
        out.append((k, " ".join(w)))
    return out


def test_large_groups_connect_through_hubs(spark, monkeypatch):
    """Links through the hub only are found, and so few members are left that hardly any pairs of chunks are made."""
    docs, like = star(150, 12), Likeness(3, 95, 100)
    want = brute(docs, like)
    assert len({c for _, c in want.values()}) == 13
    monkeypatch.setattr(jaccard, "CHUNK_NODES", 20)
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 10)
    seen = []
    real = jaccard.connecting_edges

    def watched(groups, known, compare):
        def counting(rows, hubs):
            seen.append(rows.count())
            return compare(rows, hubs)

        return real(groups, known, counting)

    monkeypatch.setattr(jaccard, "connecting_edges", watched)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, like).collect()} == want
    assert seen and sum(seen[-3:]) < 150 * 15


def test_near_copies_without_identifier_or_under_one(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows_ = [(None, base + " x"), (7, base), (7, "other words than the rest of them have"), (9, base + " y"), (None, "alone here by itself now")]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    like = Likeness(3, 90, 100)
    assert Counter((r.doc_id, r.component_id) for r in jaccard_join(df, like).collect()) == Counter([(None, 7), (7, 7), (7, 7), (9, 7), (None, None)])
    kept = jaccard.drop_near_copies(df, like).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept) == [(0, "alone"), (7, "other"), (7, "w0 w1")]


def test_hot_keys_give_the_same_tiles(spark, monkeypatch):
    rows_ = [(k, [k % 3, 10 + k % 50, 100 + k // 2]) for k in range(300)] + [(k, [k % 3]) for k in range(90)]
    docs = spark.createDataFrame(rows_, "node long, keys array<long>").repartition(4)
    plain = Counter(map(tuple, jaccard.tiles_of(docs).collect()))
    monkeypatch.setattr(jaccard, "HOT_SAMPLE", 1)
    monkeypatch.setattr(jaccard, "HOT_SEEN", 5)
    assert Counter(map(tuple, jaccard.tiles_of(docs).collect())) == plain and max(plain.values()) == 1
    assert len({t for t, n, _ in plain if n == 100}) == 3


def test_jaccard_edges(spark, odd, none):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(odd, Likeness(3, 90, 100)).collect()}
    assert found == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, 4)}
    assert jaccard_join(none).count() == 0
    kept = jaccard.drop_near_copies(odd, Likeness(3, 90, 100))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 4, 6]


def test_tiles_of_a_million_nodes(spark):
    n = 1_000_000
    keys = F.expr("explode(if(id < 3, array(1L, 2L, 3L), array(1L, 2L)))")
    keyed = spark.range(n).select(keys.alias("key"), F.xxhash64("id").alias("node"))
    keyed = keyed.unionAll(keyed.filter("key = 1 and node % 7 = 0"))
    found = jaccard.shared_tiles(keyed).groupBy("tile", "nodes").count().collect()
    assert sorted((r.nodes, r["count"]) for r in found) == [(3, 3), (n, n)]


def test_bounds_hold():
    like = Likeness(3, 90, 100)
    assert like.bands[:10].tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    for x in range(1, 200):
        for y in range(x, x * 100 // 90 + 1):
            same = -(-90 * (x + y) // 190)
            if same <= x:
                assert like.difference(x + y) == x + y - 2 * same <= like.bound(x + y)
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, 120).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 62, 20).astype(np.uint64)]))
        maps = jaccard.Bitmaps([jaccard.bitmap(a, 256).tobytes(), jaccard.bitmap(b, 64).tobytes()])
        assert maps.apart(np.array([0]), np.array([1]))[0] <= len(np.setxor1d(a, b))


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 100), (5, 5), (None, 3), (300, 301), (302, 301)]
    found = {r.node: r.root for r in cc.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 61)} | {100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in p.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"] and p.ORACLE_SQL is None
    for _, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
    assert {r.doc_id for r in p.STAGES[-1][1](spark, docs, sf).collect()} == ids
