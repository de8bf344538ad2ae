"""Each opN query over whole tables of a small folder, held against plain Python by the contract's words."""

import hashlib
import importlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from querylens import llm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, key string"


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """Tables with odd rows; doc_ids that are unique and never null, so that rows can be told apart."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, r.text, r.lang, r.source, r.n_chars, 1, "x") for i, r in enumerate(odd.collect())]
    rows += [(900 + i, " ".join(f"w{j % 700}" for j in range(i, i + 300)), "en", "hot", 1, 1, "x") for i in range(0, 40, 4)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(8)
    v = rng.normal(size=(120, 24))
    v[60:90] = v[:30] + rng.normal(size=(30, 24)) * 0.12
    v[90:100] = v[0]
    vectors = [(i, [float(x) for x in a], 0) for i, a in enumerate(v)] + [(500, None, 0), (501, [], 0), (502, [0.0] * 24, 0), (503, [float("nan")] * 24, 0), (504, [1.0, None], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    talks = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c} <|im_end|> & \U0001f600\x00" if t != 3 else None) for c in range(6) for t in range(c + 1)]
    spark.createDataFrame(talks, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def _docs(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def _run(spark, folder, prefix):
    name = next(n for n in llm.queries() if n.startswith(prefix + "_"))
    return llm.queries()[name](spark, folder).collect()


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def _crc(tokens):
    return zlib.crc32(np.array(tokens, "<u4").tobytes())


def test_op1(spark, folder):
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in _run(spark, folder, "op1")}
    expected = {}
    for i, text in _docs(spark, folder).items():
        raw = text.encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        expected[i] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got == expected


def test_op3(spark, folder, ids):
    docs, pieces, sequences = _docs(spark, folder), defaultdict(list), defaultdict(list)
    for r in _run(spark, folder, "op3"):
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in docs.items():
        tokens, at = ids(text), 0
        for start, length, crc, total in sorted(pieces.pop(i)):
            assert (start, total) == (at, len(tokens)) and crc == _crc(tokens[start : start + length])
            at += length
        assert at == len(tokens)
    assert not pieces
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024


def test_op4(spark, folder):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    good = {i: np.array(v, np.float64) for i, v in rows.items() if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = defaultdict(set)
    for i, a in good.items():
        for j, b in good.items():
            if i != j and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i].add(j)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in _run(spark, folder, "op4")}
    assert got == {i: (len(links[i]), c, c == i) for i, c in _least(rows, links).items()} and sum(map(len, links.values())) > 100


def _least(nodes, links):
    low = {}
    for i in sorted(nodes):
        todo = [] if i in low else [i]
        while todo:
            j = todo.pop()
            if j not in low:
                low[j] = i
                todo += links[j]
    return low


def test_op5(spark, folder):
    rows = _run(spark, folder, "op5")
    docs = _docs(spark, folder)
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: r["size"] for r in rows} == {i: len(WORD.findall(t)) for i, t in docs.items()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = sources[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # Water-filling by rounds: whoever is above twice its size is fixed there.
    fixed, want = {}, {}
    while True:
        free = [s for s in order if s not in fixed]
        left = 1.5 * sum(size.values()) - sum(fixed.values())
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * size[s] for s in free if want[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    want |= fixed
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1 for s in order)
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(_run(spark, folder, "op5"))]


KINDS = {"assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile(r"[0-9a-f]+"), 0, 16)}


def test_op6(spark, folder):
    got = {r.doc_id: r for r in _run(spark, folder, "op6")}
    some = 0
    for i, text in _docs(spark, folder).items():
        found = {k: [m for m in rx.finditer(text) if len(m[group]) >= least] for k, (rx, group, least) in KINDS.items()}
        spans = sorted(((m.start(), list(KINDS).index(k), f"{k}:{m.start()}:{m.end()}") for k, ms in found.items() for m in ms))
        r = got.pop(i)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(found[k]) for k in KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()
        assert {s for *_, s in spans} <= set(r.spans.split(","))
        some += len(spans)
    assert not got and some > 3


def test_op7(spark, folder):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r.conv_id].append((r.role, r.text or ""))
    talks[-1] = [(role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]
    expected = {}
    for c, turns in talks.items():
        said = "".join(t for role, t in turns if role == "assistant")
        expected[c] = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    rows = _run(spark, folder, "op7")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == expected
    assert all(r.formatted_chars > sum(len(t) for _, t in talks[r.conv_id]) for r in rows)


def test_op8(spark, folder, ids):
    expected, start = {}, 0
    for i, text in sorted(_docs(spark, folder).items()):
        tokens = ids(text)
        expected[i] = (start, len(tokens), _crc(tokens))
        start += len(tokens)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in _run(spark, folder, "op8")} == expected


def test_op10(spark, folder):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in _docs(spark, folder).items():
        w = WORD.findall(text.translate(lower))
        sets[i] = {tuple(w[j : j + 2]) for j in range(max(len(w) - 1, 1))} if w else set()
    links = defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                links[i].add(j)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in _run(spark, folder, "op10")}
    assert got == {i: (len(sets[i]), c, c == i) for i, c in _least(sets, links).items()} and len({c for c in _least(sets, links).values()}) < len(sets)
