"""Operators on vectors and urls, and the pipeline, against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from reviewloom.llm import neighbors
from reviewloom.llm.caps import embedding_groups
from reviewloom.llm.neighbors import hilbert_keys, nearest_neighbors
from reviewloom.llm.urls import judge_urls

LARGER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, node int, key string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        v = rng.standard_normal(16)
        rows.append((i, v.tolist(), i % 3))
    centre = rng.standard_normal(16)
    for i in range(400, 520):  # a dense cluster of different vectors
        rows.append((i, (centre + 0.08 * rng.standard_normal(16)).tolist(), 1))
    for i in range(520, 600):  # copies of one vector
        rows.append((i, rows[0][1], 0))
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 15 + [None], [1.0, 2.0]]
    rows += [(600 + k, v, 0) for k, v in enumerate(odd)]
    rows += [(620, rows[1][1], None), (None, rows[2][1], 2), (5, rows[5][1], 2)]
    rows = [(i, v, label, 0, "k") for i, v, label in rows]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def usable(v) -> bool:
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)


def cosine(a, b) -> float:
    a, b = (np.array(x, np.float32).astype(float) for x in (a, b))
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_embedding_groups_equal_brute_force(vectors):
    rows, frame = vectors
    n = len(rows)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            (_, a, x, *_), (_, b, y, *_) = rows[i], rows[j]
            if x is not None and x == y and usable(a) and usable(b) and len(a) == len(b) and cosine(a, b) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    expected = []
    for i in range(n):
        group, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        least = min(ids) if ids else None
        expected.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    found = [tuple(r) for r in embedding_groups(frame).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_neighbors_in_one_window_are_exact(vectors, monkeypatch):
    rows, frame = vectors
    monkeypatch.setattr(neighbors, "BLOCKS", neighbors.REACH)  # every query reaches all windows
    some = {(i, tuple(v)) for i, v, *_ in rows[:250] + rows[520:] if i is not None and usable(v)}
    frame = frame.filter("vec_id < 250 or vec_id >= 520")
    found = {}
    for r in nearest_neighbors(frame).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = [(i, v) for i, v in some if i % 50 == 0]
    assert set(found) == {i for i, v in asked if len(v) == 16}
    for i, v in asked:
        if len(v) != 16:
            continue
        near = sorted((-cosine(v, w), j) for j, w in some if j != i and len(w) == 16)[:5]
        assert [found[i][k][0] for k in range(1, 6)] == [j for _, j in near]
        np.testing.assert_allclose([found[i][k][1] for k in range(1, 6)], [-s for s, _ in near], rtol=1e-12)


@pytest.mark.parametrize("size, clusters", [(300, None), (1500, None), (6000, None), (3000, 40)])
def test_neighbors_recall(spark, size, clusters):
    """The same share of windows at every size; each answer is scored by its exact cosine."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((size, 64))
    if clusters:
        x = rng.standard_normal((clusters, 64))[rng.integers(0, clusters, size)] + 0.3 * x
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = {}
    for r in nearest_neighbors(frame, "vec_id % 20 = 0").collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in range(0, size, 20):
        score = y @ y[q]
        score[q] = -2
        assert len(found[q]) == 5
        np.testing.assert_allclose([score[j] for j in found[q]], list(found[q].values()), rtol=1e-9)
        hits += len(found[q].keys() & set(np.argsort(-score)[:5].tolist()))
    assert hits / (5 * len(found)) >= (0.99 if clusters else 0.9)


@pytest.mark.parametrize("size", [1, 2, 4, 12, 40])
def test_neighbors_of_few_rows_are_full(spark, size):
    x = np.random.default_rng(size).standard_normal((size, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest_neighbors(frame, "vec_id % 2 = 0").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == min(5, size - 1) for v in found.values())
    assert len(found) == ((size + 1) // 2 if size > 1 else 0)


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_empty_vectors(vectors):
    empty = vectors[1].limit(0)
    assert embedding_groups(empty).collect() == [] and nearest_neighbors(empty).collect() == []


# URLs

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


@pytest.fixture(scope="module")
def judged(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1?x#y", "http://example.org", "http://a.example.org/en/12",
            "http://xorg/a", "http://b.com/fr/1", "http://b.com/de/x", "http://b.com/es/1", "x://É.Com?/fr/", "http://c.com/a\nb/1",
            "http://org/fr/"]
    for i in range(60):
        urls.append(f"http://site.net/bad/{i}")
        urls.append(f"http://site.net/good/{i}.html")
        urls.append(f"http://site.net/user/{chr(97 + i % 26)}{'x' * (i // 26)}/page")
    rows = [(i, u, 0) for i, u in enumerate(urls)] + [(3, urls[3], 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    labels = [(i, int("bad" not in (u or "")), None, 1) for i, u in enumerate(urls) if i % 2 == 0 or i > 100]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, bad int")
    return rows, judge_urls(pages, labels).collect(), pages, labels


def test_url_parts_and_rules(judged):
    rows, found, *_ = judged
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    for i, url, _ in rows:
        host, path = plain_parts(url)
        assert (by_id[i].host, by_id[i].path) == (host, path), url
        rule, verdict = plain_rule(host, path)
        assert by_id[i].rule == rule
        assert by_id[i].verdict == verdict if rule else by_id[i].verdict in ("allow", "block")


def test_bad_branch_is_blocked_and_slugs_are_generalised(judged):
    verdicts = {(r.template, r.verdict) for r in judged[1] if r.host == "site.net"}
    assert verdicts == {("/bad/*", "block"), ("/good/*.html", "allow"), ("/user/*/page", "allow")}


def plain_tree(pages, bad_of):
    """{page id: (template, share)} by trees of dictionaries; ``bad_of`` maps ids to 0 or 1."""
    parsed = [(i, *plain_parts(url)) for i, url in pages]
    shapes = {}
    for i, host, path in parsed:
        parts = [p for p in path.split("/") if p]
        tail = lambda p: re.search(r"\.[A-Za-z]+$|$", p).group()
        shape = tuple("*" + tail(p) if re.search("[0-9]", p) else p for p in parts)
        shapes.setdefault(host, {}).setdefault(shape, []).append(i)
    templates = {host: {} for host in shapes}

    def walk(host, prefix, group):  # group: (rest of a shape, its pages)
        children = {}
        for rest, ids in group:
            if rest:
                children.setdefault(rest[0], []).append((rest[1:], ids))
            else:
                templates[host].setdefault(prefix, []).extend(ids)
        count = sum(len(ids) for child in children.values() for _, ids in child)
        if len(children) >= 8 and count < 3 * len(children):
            children = {"*": [x for child in children.values() for x in child]}
        for name, child in children.items():
            walk(host, (*prefix, name), child)

    for host, group in shapes.items():
        walk(host, (), list(group.items()))
    share = lambda bad, n, prior: (bad + 10 * prior) / (n + 10)
    known = [bad_of[i] for i, _ in pages if i in bad_of]
    overall, out = sum(known) / len(known) if known else 0.0, {}
    for host, leaves in templates.items():
        marks = {t: [bad_of[i] for i in ids if i in bad_of] for t, ids in leaves.items()}
        total = {}
        for t, m in marks.items():
            for n in range(len(t) + 1):
                total.setdefault(t[:n], []).extend(m)
        prior = share(sum(total[()]), len(total[()]), overall)
        branch, left = {}, {}
        for t in leaves:
            branch[t] = None
            for n in range(1, len(t) + 1):
                mine, above = total[t[:n]], total[t[: n - 1]]
                rate = share(sum(above), len(above), prior)
                if mine and 0 < rate < 1:
                    far = (sum(mine) / len(mine) - rate) / (rate * (1 - rate) / len(mine)) ** 0.5
                    if abs(far) > 1.96:
                        branch[t] = (t[: n - 1], far > 0)
            left.setdefault(branch[t], []).extend(marks[t])
        for t, ids in leaves.items():
            m = left[branch[t]]
            out |= {i: ("/" + "/".join(t), share(sum(m), len(m), prior)) for i in ids}
    return out


def test_templates_and_shares_equal_a_plain_tree(spark):
    rng = random.Random(3)
    urls = [f"http://deep.net/a/b/c/d/{'spam' if i % 2 else 'news'}/p{i}/x{i % 3}" for i in range(400)]
    urls += [f"http://deep.net/{'k/' * 60}{chr(97 + i % 26) * (1 + i // 26)}/end" for i in range(60)]
    for i in range(900):
        depth = rng.randrange(8)
        urls.append(f"http://h{i % 3}.org/" + "/".join(rng.choice("abc") + rng.choice(["", "", "z", "9.html"]) for _ in range(depth)))
    urls += [None, "http://h0.org", "http://long.net/" + "s" * 200_000 + "/" + "t/" * 300]
    bad = {i: int("spam" in (u or "") or rng.random() < (0.7 if "/a/b" in (u or "") and "deep" not in u else 0.1))
           for i, u in enumerate(urls) if rng.random() < 0.6}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    found = judge_urls(pages, labels).collect()
    expected = plain_tree(list(enumerate(urls)), bad)
    assert len(found) == len(urls)
    for r in found:
        template, share = expected[r.page_id]
        assert (r.template, round(r.bad_share, 9)) == (template, round(share, 9)), urls[r.page_id]
        assert r.rule or (r.verdict == "block") == (share >= 0.5)
    deep = {(r.template, r.verdict) for r in found if r.page_id < 400}
    assert deep == {("/a/b/c/d/news/*/*", "allow"), ("/a/b/c/d/spam/*/*", "block")}


def test_urls_without_pages_or_labels(judged):
    _, found, pages, labels = judged
    assert judge_urls(pages.limit(0), labels).collect() == []
    assert all(r.rule or r.verdict == "allow" for r in judge_urls(pages, labels.limit(0)).collect())


# Pipeline


def test_stages_work_on_what_the_one_before_kept(spark):
    source = spark.read.parquet(f"{LARGER}/documents.parquet")
    docs, seen = source, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, LARGER).cache()
        seen.append((name, out.count()))
        if name != "packing":
            assert out.columns == source.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = out
    counts = dict(seen)
    assert counts["language_id"] == counts["line_dedup"] > counts["simhash_near_dedup"] == counts["personal_data"]
    assert corpus_pipeline.run(spark, LARGER).count() == counts["packing"]
    spark.catalog.clearCache()
