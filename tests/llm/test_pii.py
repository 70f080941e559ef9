import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import pii

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2:
                total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("a@.-%+0125 ()é\n", max_size=60) | st.from_regex(PATTERNS[0] + " ?" + PATTERNS[2] + PATTERNS[3]) | st.text())
def test_base_like_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_linear():
    for s in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1.1." * 80_000, "1.2.3." * 50_000):
        pii.base_spans(s)


def test_gradient():
    p = {k: v.astype(np.float64) for k, v in pii.start(1).items()}
    x, y = (a[:3].T for a in pii.labelled(3, 3, 12))
    _, grad = pii.loss_and_grad(p, x, y)
    for k in p:
        at = np.unravel_index(np.abs(grad[k]).argmax(), p[k].shape)
        for d in (h := 1e-4, -h):
            p[k][at] += d
            other = pii.loss_and_grad(p, x, y)[0]
            p[k][at] -= d
            h = (h if d > 0 else h)
            if d > 0:
                up = other
        assert (up - other) / (2 * h) == pytest.approx(grad[k][at], rel=0.05, abs=1e-4)


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_held_out_accuracy(model):
    x, y = pii.labelled(99, 500, 80)
    got = pii.decode(model, np.ascontiguousarray(x.T)).T
    for k in range(pii.TAGS):
        both = ((got == k) & (y == k)).sum()
        assert both >= 0.85 * (got == k).sum() and both >= 0.85 * (y == k).sum()


def test_viterbi_is_best(model):
    x, _ = pii.labelled(5, 4, 5)
    got = pii.decode(model, np.ascontiguousarray(x.T)).T
    for row, tags in zip(x, got, strict=True):
        e = (pii._scores(model, "f", row[:, None].astype(int)) + pii._scores(model, "b", row[::-1, None].astype(int))[::-1])[:, :, 0] + model["bias"]
        e[row == pii.PAD, 0] = 1e4
        score = lambda t: sum(e[i, k] for i, k in enumerate(t)) + sum(model["trans"][a, b] for a, b in zip(t, t[1:], strict=False))
        best = max(score(t) for t in np.ndindex(*[5] * 5))
        assert score(tags) == pytest.approx(best, abs=1e-2)


def plain_decode(p, x):
    """One step after another, each gate and each pair of tags by itself."""
    n, e = pii.HIDDEN, 0
    half = np.concatenate([np.full(3 * n, 0.5, np.float32), np.ones(n, np.float32)])[:, None]
    for d, way in (("f", 1), ("b", -1)):
        w, u = p["w" + d] * half, p["u" + d] * half
        h = c = np.zeros((n, x.shape[1]), np.float32)
        out = np.empty((len(x), pii.TAGS, x.shape[1]), np.float32)
        for t in range(len(x)):
            z = np.tanh(np.take(w, x[::way][t], axis=1) + u @ h)
            i, f, o, g = *(0.5 * z[k * n : (k + 1) * n] + np.float32(0.5) for k in range(3)), z[3 * n :]
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = p["v" + d] @ h
        e = e + out[::way]
    e += p["bias"][None, :, None]
    e[:, 0][x == pii.PAD] = 1e4
    came, score = np.zeros(e.shape, np.uint8), e[0]
    for t in range(1, len(x)):
        best = score[0] + p["trans"][0][:, None]
        for k in range(1, pii.TAGS):
            other = score[k] + p["trans"][k][:, None]
            np.copyto(came[t], k, where=other > best)
            best = np.maximum(best, other)
        score = best + e[t]
    tags = [score.argmax(0)]
    for t in range(len(x) - 1, 0, -1):
        tags.append(came[t, tags[-1], np.arange(x.shape[1])])
    return np.array(tags[::-1])


@pytest.mark.parametrize("quick", [True, False])
def test_decode_like_plain_steps(model, monkeypatch, quick):
    monkeypatch.setattr(pii, "QUICK_TANH", quick)
    x, _ = pii.labelled(11, 128, 150)
    x = np.ascontiguousarray(np.tile(x, (4, 1)).T)
    for some in (x, x[:, :127], x[:, :1], x[:1]):
        assert (pii.decode(model, some) == plain_decode(model, some)).mean() > 0.999  # but for rounding


def test_tanh_where_it_is_slow(model, monkeypatch):
    x = pii.labelled(11, 128, 150)[0].T.astype(np.intp)
    monkeypatch.setattr(pii, "QUICK_TANH", True)
    big = {k: 40 * v for k, v in model.items()}
    want = [pii._scores(p, "f", x) for p in (model, big)]
    monkeypatch.setattr(pii, "QUICK_TANH", False)
    monkeypatch.setattr(np, "tanh", None)
    assert np.allclose(pii._scores(model, "f", x), want[0], atol=1e-4)
    assert np.isfinite(pii._scores(big, "f", x)).all() and np.isfinite(want[1]).all()


def test_two_windows_a_lookup(model, monkeypatch):
    x, looked, take = np.full((30, 64), pii.DIGIT, np.uint8), [], np.take
    monkeypatch.setattr(np, "take", lambda table, at, **kw: (looked.append(np.size(at)), take(table, at, **kw))[1])
    pii.decode(model, x)
    assert 0 < sum(looked) <= x.size  # both directions together


def test_no_search_without_at(monkeypatch):
    monkeypatch.setattr(pii, "EMAIL_LIKE", None)
    text = "words that mean no place, latter dotted.com (atlas) " * 3
    assert pii.model_spans(text, np.ones(len(text), np.uint8)) == []


@settings(max_examples=400, deadline=None)
@given(st.text("01259.", max_size=40))
def test_ips_like_pattern(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.from_regex(pii.EMAIL_LIKE))
def test_email_like_has_at(text):
    assert any(x in text for x in pii.AT)


def test_windows_agree(model):
    text = "tion and here, mail jane.doe [at] mail [dot] org thereon. " * 60
    (base, every), = pii.find(model, [text])
    assert base == [] and len(every) >= 50
    assert {text[a:b] for _, a, b in every} <= {"jane.doe [at] mail [dot] org"}


def test_query_edges(spark, tmp_path, model):
    rows = [(1, None), (2, ""), (3, "a@b.co, 1.2.3.4 4111 1111 1111 1111 +1 (743) 555-3824"), (3, "a@b.co, 1.2.3.4 4111 1111 1111 1111 +1 (743) 555-3824"), (None, "plain words only and no more"), (5, "word " * 30000)]
    spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, spans long").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op1_pii(spark, str(tmp_path)).collect()
    assert len(got) == 6
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        base = brute(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(r.spans.split(","))


def test_redacted(spark):
    df = spark.createDataFrame([(1, "to a@b.co now"), (2, None), (3, "nothing here")], "doc_id long, text string")
    assert sorted(tuple(r) for r in pii.redacted(df, ["doc_id"]).collect()) == [(1, "to [email] now"), (2, None), (3, "nothing here")]
    assert pii.redacted(df.limit(0), ["doc_id"]).collect() == []
