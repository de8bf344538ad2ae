"""Embeddings, urls and conversations against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from querylens.llm import chat_format, embedding_dedup, url_templates


def brute_links(rows):
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, np.float64) / np.linalg.norm(v) if ok else None)
    near = [[j for j, u in enumerate(units) if j != i and u is not None and units[i] is not None and len(u) == len(units[i]) and u @ units[i] >= 0.95] for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(near[i]), min(ids) if ids else d))
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings(spark, kind):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(30):
        base = rng.normal(size=16)
        rows += [(len(rows) + i, (base + rng.normal(size=16) * s).astype(np.float32).tolist()) for i, s in enumerate([0, 0.05, 0.2, 0.3, 0.0][: rng.integers(1, 6)])]
    hub = rng.normal(size=16)
    rows += [(1000 + i, (hub + rng.normal(size=16) * 0.1).astype(np.float32).tolist()) for i in range(300)]
    rows += [(2000 + i, [1.0] + [0.0] * 15) for i in range(20)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [float("inf")] + [1.0] * 15), (3005, [None] + [1.0] * 15), (3006, [1.0]), (3007, [2.0]), (None, [-1.0]), (3008, [1.0] + [-0.0] * 15), (7, rows[7][1])]
    df = spark.createDataFrame([(a, b, 0, "x") for a, b in rows], f"vec_id long, embedding array<{kind}>, label int, key string")
    got = embedding_dedup.near_vectors(df).collect()
    expected = brute_links(rows)
    links = sum(n for _, n, _ in expected)
    assert sum(r.n_links for r in got) >= 0.999 * links
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(expected)
    none = spark.createDataFrame([], f"vec_id long, embedding array<{kind}>")
    assert embedding_dedup.near_vectors(none).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    y = 0.8 * x + 0.6 * rng.normal(size=x.shape)
    x, y = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
    signs, factor, _ = embedding_dedup.codes(x)
    _, _, turned = embedding_dedup.codes(y)
    true = (x * y).sum(1)
    estimate = embedding_dedup.upper_bounds(signs, factor, turned, sure=0.0)
    assert abs((estimate - true).mean()) < 0.005
    assert (embedding_dedup.upper_bounds(signs, factor, turned) >= true).all()


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM", "https://x.com/en/1?q=/en/", "http://com/en/", "http://xcom/en/3", "http://a.example.com/en/7x", "http://b.net/de/8", "http://a.example.net/de/8#z", "http://a.org/es", "http://a.org/es/", "http://É.ORG/es/\nx", "a://b://c/d", "http://h?x", "//h/p", "http://u.example.com:80/en/2"]
    urls += [f"http://spam.com/{'en' if i % 2 else 'promo'}/{i}" for i in range(60)] + [f"http://site.example.org/{'es' if i % 3 else 'fr'}/{i}" for i in range(60)] + [f"http://big.net/p/name{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(100)]
    df = spark.createDataFrame([(i if i else None, u, "<p>", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, template int")
    got = sorted(url_templates.filter_urls(df).collect(), key=lambda r: r.page_id or 0)
    assert len(got) == len(urls)
    for u, r in zip(urls, got):
        host, path = url_parts(u)
        fits = [x for x in url_templates.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.rule)) if fits else None
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.rule)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    by = {r.path: r for r in got}
    assert by["/en/1"].template == "/en/*" and by["/p/namea"].template == "/p/*"
    assert url_templates.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://shop.io/{'deal' if i % 4 == 0 else 'item'}/{i}") for i in range(400)]
    df, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 400, 3)], "page_id long, bad boolean")
    got = url_templates.filter_urls(df, (), labels).collect()
    assert all(r.verdict == ("block" if r.page_id % 4 == 0 else "allow") for r in got)


def test_templates_do_not_turn_on_repetition(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05d}")
    once = [f"http://news.io/story/{word(i)}" for i in range(60)] + [f"http://news.io/{word(b)}/page/{i}" for b in range(3) for i in range(5)] + [f"http://deep.io/a/b/c/d/e/f/{'good' if i % 2 else 'bad'}/x/{i}" for i in range(60)]
    made = {}
    for times in (1, 3):
        urls = [f"{u}?session={t}" for u in once for t in range(times)]
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        labels = spark.createDataFrame([(i, "/bad/" in u) for i, u in enumerate(urls) if "deep.io" in u], "page_id long, bad boolean")
        got = url_templates.filter_urls(df, (), labels).collect()
        made[times] = {(r.host, r.path): (r.template, r.verdict) for r in got}
    assert made[1] == made[3]
    assert {t for (h, p), (t, _) in made[3].items() if p.startswith("/story/")} == {"/story/*"}
    assert all((v == "block") == ("/bad/" in p) and t == f"/a/b/c/d/e/f/{p.split('/')[7]}/x/*" for (h, p), (t, v) in made[3].items() if h == "deep.io")


def brute_templates(urls):
    """(template, purity, rejected) by (host, path), in plain Python, of (host, path, bad or None)."""
    t = url_templates
    groups = {}
    for host, path, bad in urls:
        groups.setdefault((host, path), []).append(bad)
    at = {k: ("", k[1][1:].split("/") if k[1] else []) for k in groups}
    kind = lambda parts, i: "end" if i >= len(parts) else "slash" if parts[i] == "" else "digits" if re.search("[0-9]", parts[i]) else "word"

    def js(p, q):
        p, q = ([x / sum(v) for x in v] for v in (p, q))
        return 0.5 * sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q))

    for level in range(max(len(p) for _, p in at.values())):
        branches = {}
        for key, (template, parts) in at.items():
            if kind(parts, level) == "word":
                cells = branches.setdefault((key[0], template), {}).setdefault(parts[level], [[0.0] * 12, 0])
                labels = groups[key]
                for j, share in enumerate((sum(x is True for x in labels), sum(x is False for x in labels), sum(x is None for x in labels))):
                    cells[0][3 * t.KINDS.index(kind(parts, level + 1)) + j] += share / len(labels)
                cells[1] += 1
        step = {}
        for parent, segments in branches.items():
            if len(segments) >= t.MANY and sum(n for _, n in segments.values()) <= len(segments) * t.MOST_OFTEN:
                step |= {(*parent, s): "*" for s in segments}
                continue
            buckets = {}
            for s, (v, n) in segments.items():
                step[(*parent, s)] = s
                if n >= t.SEEN:
                    buckets.setdefault(tuple(math.floor(round(x / n, 9) * t.GRID + 0.5) for x in v), []).append(s)
            for names in buckets.values():
                pooled = [sum(x) for x in zip(*(segments[s][0] for s in names))]
                alike = [s for s in names if js(segments[s][0], pooled) <= t.ALIKE]
                if len(alike) > 1:
                    step |= {(*parent, s): f"({min(alike)}+)" for s in alike}
        for key, (template, parts) in at.items():
            if (k := kind(parts, level)) != "end":
                at[key] = (template + "/" + {"slash": "", "digits": "*"}.get(k, step.get((key[0], template, parts[level]))), parts)
    count = Counter()
    for key, labels in groups.items():
        for where in ((key[0], at[key][0]), key[0], None):
            count[where, "n"] += sum(x is not None for x in labels)
            count[where, "bad"] += sum(x is True for x in labels)
    out = {}
    for key in groups:
        own, host = (key[0], at[key][0]), key[0]
        prior = (count[host, "bad"] + t.STRENGTH * (count[None, "bad"] + 1) / (count[None, "n"] + 2)) / (count[host, "n"] + t.STRENGTH)
        purity = (count[own, "bad"] + t.STRENGTH * prior) / (count[own, "n"] + t.STRENGTH)
        out[key] = (at[key][0], round(purity, 9), count[own, "n"] > 0 and purity >= t.REJECT)
    return out


def test_templates_equal_a_plain_tree(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    urls = []
    for h in range(4):
        host = f"h{h}.io"
        for section in ("alpha", "beta", "gamma", "deal", "win", "x", ""):
            shape = int(rng.integers(0, 4))
            for i in range(int(rng.integers(1, 40))):
                rest = (f"/{i}", f"/{word()}/{i}", "", f"/{word()}/{word()}/c/d/e/f/g/h/{'good' if i % 2 else 'bad'}")[shape]
                bad = None if rng.random() < 0.4 else bool((section in ("deal", "win") or rest.endswith("bad")) and rng.random() < 0.95)
                urls += [(host, f"/{section}{rest}", bad)] * int(rng.integers(1, 3))
    urls += [("alike.io", f"/{b}/{i}", None) for b in ("alpha", "beta") for i in range(9)] + [("alike.io", f"/{b}/{'z' * i}/q", None) for b in ("one", "two", "six") for i in range(1, 12)] + [("empty.io", "", None)]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (*_, b) in enumerate(urls) if b is not None], "page_id long, bad boolean")
    expected = brute_templates(urls)
    got = {(r.host, r.path): (r.template, round(r.purity, 9), r.verdict == "block") for r in url_templates.filter_urls(df, (), labels).collect()}
    assert got == expected
    assert expected["alike.io", "/alpha/3"][0] == "/(alpha+)/*" == expected["alike.io", "/beta/3"][0] and len({t for t, *_ in expected.values()}) > 20
    assert any(block for *_, block in expected.values()) and any("+)" in t for t, *_ in expected.values())


def test_op2_columns(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.com/en/1", "<p>"), (2, None, None), (None, "x://b.io/q", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.op2_url_templates(spark, str(tmp_path)).collect()}
    assert got == {1: ("a.com", "/en/1", "com/en/", "block"), 2: ("", "", None, "allow"), None: ("b.io", "/q", None, "allow")}


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_start|> and <\\|x and < | <|"), (2, 1, "assistant", "second"), (2, 0, "user", None), (3, 0, None, "no role"), (3, 0, "assistant", ""), (None, 5, "user", "lost"), (None, 6, "assistant", "kept"),
    (4, None, "user", "early"), (4, 0, "a\nb\\n<|", "odd role"), (5, 0, "assistant", "été \U0001f600"), (5, 0, "assistant", "été \U0001f600"), (6, 0, "user", "<" + "\\" * 5 + "|"), (7, 0, "user", "x" * 100_000),
]


def test_chats(spark):
    df = spark.createDataFrame([(*c, "f", 0) for c in CHATS], "conv_id long, turn long, role string, text string, formatted string, loss_start int")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(df)).collect()}
    whole = {r.conv_id: r for r in chat_format.conversations(df).collect()}
    key = lambda c: (c[1] is not None, c[1] or 0, c[2] is not None, c[2] or "", c[3] is not None, c[3] or "")
    for conv in {c[0] for c in CHATS}:
        turns = sorted((c for c in CHATS if c[0] == conv), key=key)
        said = [((c[2] or ""), (c[3] or "")) for c in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        g, w = got[conv], whole[conv]
        assert chat_format.parse(w.formatted) == said
        assert g.n_turns == len(said) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and g.formatted_chars == len(w.formatted)
        assert "".join(chat_format.unescape(w.formatted[s.start : s.end]) for s in w.loss_spans) == loss
    assert chat_format.digests(chat_format.formatted(spark.createDataFrame([], df.schema))).count() == 0
