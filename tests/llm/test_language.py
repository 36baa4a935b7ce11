import pytest
from pyspark.sql import functions as F

from orrery.llm import language_id as L


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = L.query(docs).join(docs, "doc_id")
    assert out.count() == docs.count()
    wrong = out.where("language <> lang AND letters > 0").count()
    assert wrong <= 0.02 * docs.count()
    assert L.known(docs).count() >= 0.99 * docs.count()
    assert L.known(docs).columns == docs.columns


def test_pages_with_markup_language_and_address(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").selectExpr("page_id AS doc_id", "regexp_replace(html, '<[^>]*>', ' ') AS text", "regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS declared", "url", "1 AS host", "2 AS says")
    out = L.identify(pages, "declared", "url").join(pages.select("doc_id", "declared"), "doc_id")
    assert out.where("language <> declared").count() <= 0.05 * out.count()


def test_weak_text_leans_on_host_and_declaration(spark):
    en, fr = "the cat and the dog were there with other things ", "le chat et les chiens sont avec nous dans une maison "
    rows = [(i, en * 3, "en", "en.example.org") for i in range(30)] + [(100 + i, fr * 3, "fr", "fr.example.org") for i in range(30)]
    rows += [(200, "on", "fr", "fr.example.org"), (201, "on", "en", "en.example.org")]
    out = {r["doc_id"]: r["language"] for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, d string, a string"), "d", "a").collect()}
    assert out[200] == "fr" and out[201] == "en" and out[5] == "en" and out[105] == "fr"


@pytest.mark.parametrize("limit", [L.MAX_BROADCAST, 0])
def test_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "MAX_BROADCAST", limit)
    text = "plain words of one language here "
    rows = [(i, text * 3, "en", "h", 1) for i in range(20)] + [(50, None, "en", None, 1), (51, "", None, None, 1), (52, "12 34 !!", "en", "h", 1), (None, text, None, None, 1), (None, None, "xx", "h", 1), (53, text * 5000, "en", "h", 1), (1, text * 3, "en", "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, letters int")
    out = [(r["doc_id"], r["language"], r["rejected"]) for r in L.query(docs).collect()]
    assert len(out) == len(rows) and {d for d, _, gone in out if gone} == {50, 51, 52, None} and all((lang == "und") == gone for _, lang, gone in out)
    assert L.known(docs).count() == len(rows) - 4
    assert L.query(docs.limit(0)).count() == 0
    assert L.query(docs.withColumn("lang", F.lit(None).cast("string"))).where("NOT rejected").count() == 0


def test_rare_languages_stay(spark):
    en, el, ca = "the cat and the dog were there with other things ", "η γάτα και ο σκύλος ήταν εκεί μαζί με άλλα πράγματα ", "el gat i el gos eren allà amb altres coses "
    rows = [(i, en * 40, "en", "h") for i in range(3000)] + [(5000 + i, el * 20, "el", "h") for i in range(3)]  # 0.1 percent, with text enough
    rows += [(6000, ca, "ca", "h"), (6001, "много слов на языке без модели здесь", "ru", "h"), (6002, "много слов", "", "h"), (6003, "много слов", None, "h"), (6004, "12", "ru", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: (r["language"], r["rejected"]) for r in L.query(docs).collect()}
    assert len(out) == len(rows) and {out[5000 + i] for i in range(3)} == {("el", False)} and {out[i] for i in range(3000)} == {("en", False)}
    assert out[6001] == ("ru", False) and not out[6000][1] and all(out[i] == ("und", True) for i in (6002, 6003, 6004))


def test_many_small_languages(spark, monkeypatch):
    monkeypatch.setattr(L, "GROUP", 2)
    words = {f"x{k}": " ".join(chr(0x400 + 20 * k + j) * 3 for j in range(9)) + " " for k in range(7)}
    docs = spark.createDataFrame([(10 * k + i, w * 9, n, "h") for k, (n, w) in enumerate(words.items()) for i in range(4)], "doc_id long, text string, lang string, source string")
    assert all(r["language"] == f"x{r['doc_id'] // 10}" and not r["rejected"] for r in L.query(docs).collect())
    alone = spark.createDataFrame([(i, "kurz", f"v{i}", "h") for i in range(1000)] + [(5000, "1", "w", "h")], "doc_id long, text string, lang string, source string")
    assert L.known(alone).count() == 1000  # no value has text enough, or a share


def brute(rows):
    """(language, posterior) of rows (text, declared, host), number by number, by the rule of the module's docstring."""
    import math
    from collections import Counter, defaultdict

    def trigrams(text):
        b = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in b" " + (text or "").encode() + b" ")
        return [(((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 0x9E3779B1) % (1 << 32)) >> 16 for i in range(1, len(b) - 1) if b[i] != 32]

    grams = [trigrams(t) for t, _, _ in rows]
    declared = Counter(d for _, d, _ in rows if d is not None)
    counts = {d: Counter() for d in declared if d}
    for (_, d, _), g in zip(rows, grams, strict=True):
        if d:
            counts[d].update(g)
    names = sorted(d for d in counts if declared[d] >= L.MIN_SHARE * sum(declared.values()) or sum(counts[d].values()) >= L.MIN_TRIGRAMS)
    logs = {d: {k: math.log((counts[d][k] + 0.5) / (sum(counts[d].values()) + 0.5 * L.BUCKETS)) for k in {x for g in grams for x in g}} for d in names}

    def normal(xs):
        top = max(xs)
        powers = [math.exp(x - top) for x in xs]
        return [p / sum(powers) for p in powers]

    lik = []
    for g in grams:
        scale = min(len(g), L.TEMPER) / max(len(g), 1)
        lik.append([scale * sum(logs[d][k] for k in g) for d in names] + [-scale * len(g) * math.log(L.BUCKETS)])
    says = [normal(x)[:-1] if g else [0.0] * len(names) for x, g in zip(lik, grams, strict=True)]
    add = lambda keys: {k: [sum(s[i] for s, x in zip(says, keys, strict=True) if x == k) for i in range(len(names))] for k in set(keys)}
    suffix = [h.rpartition(".")[2] if h and "." in h else None for _, _, h in rows]
    whole, by_suffix, by_host, by_value = add([0] * len(rows))[0], add(suffix), add([h for _, _, h in rows]), add([d for _, d, _ in rows])
    smoothed = lambda own, parent: [(x + L.SMOOTH * p) / (sum(own) + L.SMOOTH) for x, p in zip(own, parent, strict=True)]
    top = smoothed(whole, [1 / len(names)] * len(names))
    out = defaultdict(list)
    for r, (_, d, h) in enumerate(rows):
        prior = smoothed([max(x - s, 0.0) for x, s in zip(by_host[h], says[r], strict=True)], smoothed(by_suffix[suffix[r]], top))
        says_value = [math.log((v + 1 / L.SMOOTH) / (w + 1)) for v, w in zip(by_value[d], whole, strict=True)]
        posterior = normal([x + math.log(p * (1 - L.UND_PRIOR)) + v for x, p, v in zip(lik[r], prior, says_value, strict=False)] + [lik[r][-1] + math.log(L.UND_PRIOR) + max(says_value)])
        best = max(range(len(posterior)), key=posterior.__getitem__)
        unclear = best == len(names) or posterior[best] < L.MIN_POSTERIOR
        keeps = bool(d) and d not in names
        language = L.UND if not grams[r] or (unclear and not keeps) else d if unclear else names[best]
        out[r] = (language, posterior[best])
    return out


@pytest.mark.parametrize("limit", [L.MAX_BROADCAST, 0])
def test_equals_brute_force(spark, data, monkeypatch, limit):
    """Documents of the table, short texts of mixed languages, declared rightly, wrongly or not at all."""
    import random

    monkeypatch.setattr(L, "MAX_BROADCAST", limit)
    rng = random.Random(8)
    base = [(r["text"][:600], r["lang"]) for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 300").limit(60).collect()]
    rows = [(t, d, f"h{i % 5}.{'org' if i % 3 else d}") for i, (t, d) in enumerate(base)]
    for _ in range(60):
        words = rng.choice(base)[0].split()[: rng.randint(0, 6)] + rng.choice(base)[0].split()[: rng.randint(0, 3)]
        rows.append((" ".join(words), rng.choice(["en", "de", "fr", "es", None, "", "xx"]), rng.choice(["h0.org", "h1.de", "plain", None])))
    want = brute(rows)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, d string, host string")
    for r in L.identify(docs, "d", "host").collect():
        assert abs(r["posterior"] - want[r["doc_id"]][1]) < 1e-3, (rows[r["doc_id"]], r)
        assert r["language"] == want[r["doc_id"]][0] or abs(want[r["doc_id"]][1] - 0.5) < 0.01, (rows[r["doc_id"]], r, want[r["doc_id"]])
