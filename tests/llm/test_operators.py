"""The corpus operators against brute force, on a small corpus of odd cases and on the driver's smallest tables."""

import hashlib
import html
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from folioframe.llm import bpe, components, exact_dedup, fingerprint, html_crf, html_pages, langid, mixing, queries, sharding, simhash, token_counts, url_filter

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, __id long"
TEXTS = [
    None, "", " \t\n", "one", "two words", "a b c d e f g", "A b C d E f g", "a b c d e f g", "a b c d e f g", "ümläut Straße ÀÉ", "日本語 テキスト", "x" * 5000, "word " * 3000, "don't <|endoftext|> I'LL 123 ??? \u00a0 q",
    "\x1c\x85z", "é combining", "🎉 party 🎉", "İstanbul", "a" * 1024, "a" * 1025, "a" * 2048 + "b", "12 34 !!",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, ties, repeated rows, extra columns with clashing names."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "clash", 7) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s0", 3, "clash", 7), (3, "one", "en", "s0", 3, "clash", 7), (3, "another", "de", "s1", 3, None, None), (None, "one", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_bpe_equals_the_library(which, request):
    from tokenizers import Tokenizer

    df, lib = request.getfixturevalue(which), Tokenizer.from_file(TOKENIZER)
    rows = df.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), _sha(" ".join(map(str, ids))), _sha(lib.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(map(tuple, bpe.encode_digests(df, TOKENIZER).collect())) == want


def test_bpe_round_trip(odd):
    got = bpe.encode_texts(odd, TOKENIZER).select("ids", F.col("decoded").alias("first"))
    again = bpe.decode_ids(got, TOKENIZER, keep=("first",)).collect()
    assert again and all(r.first == r.decoded for r in again)


def test_bpe_cuts_never_change_ids():
    own = bpe.ForcedBoundaryEncoder(TOKENIZER)
    rng = np.random.default_rng(5)
    lib = own.tokenizer
    for _ in range(500):
        text = "".join(chr(c) for c in rng.choice([*range(33, 127), 228, 233, 960, 12354, 128512], 40))
        assert own.encode(text)[0] == " ".join(map(str, lib.encode(text, add_special_tokens=False).ids))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_exact_duplicates(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    got = exact_dedup.exact_duplicates(df).collect()
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, keep[t], len(groups[t]), _sha(t)) for i, t in rows)
    assert Counter((r.keep_id, r.text_sha256) for r in got if r.kept) == Counter((keep[t], _sha(t)) for t in groups)
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted(groups)


def test_block_names_survive_shared_addresses(odd):
    got = exact_dedup.identities(odd, address=lambda b: F.xxhash64(b) % 3).collect()
    assert len({(r.level, r.name) for r in got}) == len({r.text_sha256 for r in got})


def _languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, langid.profiles(docs.where(~langid.held_out()))


def test_language_held_out_accuracy(spark):
    docs, model = _languages(spark)
    got = langid.identify(docs.where(langid.held_out()), model, keep=("doc_id", "lang")).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_profiles_equal_brute_force(odd):
    model = langid.profiles(odd, size=30).collect()
    counts = {}
    for r in odd.where("text is not null and lang is not null").collect():
        grams, n = langid._counts(r.text)
        counts.setdefault(r.lang, Counter()).update(dict(zip(grams.tolist(), n.tolist())))
    for lang, c in counts.items():
        want = [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:30]]
        assert [r.gram for r in sorted((r for r in model if r.lang == lang), key=lambda r: r["rank"])] == want


def test_language_odd_cases(spark, odd, empty):
    docs, model = _languages(spark)
    got = {r.text: (r.lang_pred, r.score) for r in langid.identify(odd, model, keep=("text",)).collect()}
    assert got[None] == got[""] == got["12 34 !!"] == ("und", 0.0)
    assert got["one"][0] != "und"
    assert langid.identify(odd, langid.profiles(empty)).where("lang_pred <> 'und'").isEmpty()


def _simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _least(links, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(odd):
    rows = odd.select("doc_id", "text").collect()
    fps = [_simhash(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    root = _least(links, range(len(rows)))
    ids = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            ids[root[i]] = min(ids.get(root[i], r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{fps[i]:016x}", ids.get(root[i])) for i, r in enumerate(rows))
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == want


def test_anchor_covering_loses_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 60)
    fps = {int(x) for x in base}
    for x in base:
        for k in (1, 2, 2, 3):
            y = int(x)
            for b in rng.choice(64, k, replace=False):
                y ^= 1 << int(b)
            fps.add((y + 2**63) % 2**64 - 2**63)
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 150


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(2)
    names = rng.permutation(400).tolist()
    links = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 260)] + [(7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    want = _least(links[:-1], {x for p in links[:-1] for x in p})
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_mix_reaches_targets(odd, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text", "source").collect()
        size = Counter()
        for r in rows:
            size[r.source] += len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
        names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        capped = set()
        while True:
            level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
            more = {s for s in names if s not in capped and weight[s] * level > 3 * size[s]}
            if not more:
                break
            capped |= more
        got = mixing.mix(df).toPandas()
        assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got["size"] * got.copies == got.taken).all()
        for s in names:
            own = got[got.source.isna()] if s is None else got[got.source == s]
            target = 3 * size[s] if s in capped else weight[s] * level
            assert own["size"].sum() == size[s] == own.source_size.iloc[0] and abs(own.target - target).max() < 1e-6
            assert abs(own.taken.sum() - target) <= max(1, own["size"].max())
        again = mixing.mix(df.repartition(3)).toPandas()
        columns = ["doc_id", "source", "size", "taken"]
        assert Counter(map(str, got[columns].values.tolist())) == Counter(map(str, again[columns].values.tolist()))


def test_mixed_rows_come_as_often_as_taken(odd):
    got = mixing.mix(odd)
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == got.agg(F.sum("copies")).first()[0]


def test_cube_keeps_both_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 400).astype(float), np.full(400, 0.37)
    before = (p @ size, p.sum())
    mixing._flight(p, np.vstack([size, np.ones(400)]), rng)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p @ size - before[0]) < 1e-6 and abs(p.sum() - before[1]) < 1e-6


def test_html_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_crf.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        body = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def test_html_held_out_labels():
    chain, wrong, total = html_crf.trained(), 0, 0
    for page in html_pages.labelled_pages(150, seed=99):
        labels = [html_pages.MARK in b.text for b in html_crf.blocks(page)]
        got = chain.decode(html_crf.blocks(page.replace(html_pages.MARK, "")))
        wrong, total = wrong + sum(a != b for a, b in zip(labels, got)), total + len(labels)
    assert wrong < 0.03 * total


def test_html_viterbi_equals_enumeration():
    chain = html_crf.trained()
    page = html_crf.blocks(html_pages.labelled_pages(1, seed=5)[0])[:9]

    def score(labels):
        s = chain.start * labels[0]
        for k, b in enumerate(page):
            s += labels[k] * sum(chain.weights.get(f, 0) for f in b.features) + (chain.step[labels[k - 1]][labels[k]] if k else 0)
        return s

    best = max(([*map(int, f"{i:0{len(page)}b}")] for i in range(1 << len(page))), key=score)
    assert [int(x) for x in chain.decode(page)] == best


def test_html_odd_pages(spark):
    odd = [None, "", "plain text", "<p>a &lt;b&gt; c&nbsp;d<p>unclosed <b>x</b>y", "<script>var a='<p>no</p>'", "<div><<< > & &amp; <a href='>'>link</a>", "<!-- open", "<p>" * 3000]
    df = spark.createDataFrame([(i, None, h, 1) for i, h in enumerate(odd)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_crf.extract(df).collect()}
    assert len(got) == len(odd) and got[0].text == got[1].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert [b.text for b in html_crf.blocks(odd[3])] == ["a <b> c d", "unclosed xy"]


def _shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprint_likeness(docs):
    got = {r.doc_id: r for r in fingerprint.edit_likeness(docs).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    off = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)].text
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == _sha(edited) and 0 <= r.near_edited <= 1
        off += [r.near_edited - _jaccard(_shingles(text), _shingles(edited)), r.near_next - _jaccard(_shingles(text), _shingles(following))]
    assert np.abs(off).mean() < 0.03 and abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.25


def test_fingerprint_odd_cases(odd):
    got = fingerprint.edit_likeness(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()), r.doc_id, r.text or "") for r in rows)
    want = Counter()
    for i, (_, doc_id, text) in enumerate(order):
        following, half = order[(i + 1) % len(order)][2], len(text) // 2
        want[(doc_id, len(text), _sha(text[: len(text) - half] + following[:half]))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for r in fingerprint.fingerprints(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        by_text.setdefault(r.fingerprint, set()).add(r.text)
    assert "" in by_text


def test_sharding_is_exact_and_bounded(odd, docs):
    for df, n in ((odd, 8), (docs, 8), (docs, 3)):
        got = sharding.assign(df, n).toPandas()
        counts = got.groupby("shard").size().reindex(range(n), fill_value=0)
        assert len(got) == df.count() and counts.max() - counts.min() <= 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
        again = sharding.assign(df.repartition(5), n).toPandas()
        assert Counter(map(str, got.values.tolist())) == Counter(map(str, again.values.tolist()))


def test_ring_orders():
    rings = sharding.ring(5, 4, 64)
    assert all(sorted(x) == list(range(5)) for x in rings)
    assert all(a == b or a[0] != b[0] or a[1:] != b[1:] for a, b in zip(rings, rings[1:]))
    # one more shard moves a cell's home only to itself
    assert all(b[0] in (a[0], 5) for a, b in zip(rings, sharding.ring(6, 4, 64)))


def test_token_counts(odd, docs, empty):
    for df in (odd, docs):
        lengths = [r.n_tokens for r in bpe.token_lengths(df, TOKENIZER).collect()]
        sums = token_counts.suffix_sums(token_counts.length_histogram(df, TOKENIZER)).cache()
        for r in sums.collect():
            assert (r.docs, r.docs_from, r.docs_to) == (lengths.count(r.n_tokens), sum(x >= r.n_tokens for x in lengths), sum(x <= r.n_tokens for x in lengths))
            assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens) and r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        for limit in (0, 1, 7, 100, 10**6):
            assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
        assert token_counts.quantile(sums, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    sums = token_counts.suffix_sums(token_counts.length_histogram(empty, TOKENIZER))
    assert sums.isEmpty() and token_counts.truncated_total(sums, 5) == 0 and token_counts.quantile(sums, 0.5) is None


def _judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [h + p for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_regression(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://a.example.com/en/", "http://example.com?q=/en/", "http://x.net/es/1", "http://net/fr/", "http://xnet/es/", "ftp://a://b.com/c", "http://ÄB.com/\n/x", "https://casino-win.example.org/en/1", "https://cheap-pills.info/x", "https://library.org/books", "https://therst.example.org/de/5"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").union(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 100", "url", "'h'", "'r'"))
    want = {r.page_id: _judged(r.url) for r in df.collect()}
    kinds = {h + p: k for k, h, p in url_filter.RULES}
    got = url_filter.judge(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.host, r.path, r.rule) == want[r.page_id]
        assert r.verdict == kinds[r.rule] if r.rule else r.verdict in ("allow", "block")
    verdict = {r.page_id: r.verdict for r in got}
    assert [verdict[i] for i in (0, 13, 14, 15, 16)] == ["allow", "block", "block", "allow", "allow"]


def test_url_regression_on_held_out_names(spark):
    rows = url_filter.labelled_urls(400, seed=11)
    parts = url_filter.with_parts(spark.createDataFrame(rows, "url string, label int"), keep=("label",))
    scored = url_filter.train(spark).transform(parts.withColumn("grams", url_filter.grams(F.col("host"), F.col("path"))).withColumn("label", F.col("label").cast("double")))
    assert scored.where("prediction = label").count() > 0.95 * len(rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, tmp_path, name):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    # op11 has one conversation of its own.
    assert [r.conv_id for r in queries.QUERIES[name](spark, str(tmp_path)).collect()] == [-1] if name == "op11_chat" else queries.QUERIES[name](spark, str(tmp_path)).isEmpty()
