"""The semi-Markov field on texts full of digits: features against a plain version, the best segmentation against all of them, and
time."""

import random
import re
import time

import numpy as np
import pytest

from lumicat.llm import pii

PIECES = ["1", "12", "123", "2024", "00", "555", "255", "1234", ".", "-", "+", "(", ")", " ", "  ", "\n", ":", "a", "at", "mail", "@", "[at]", " (dot) ", "[.]", "é", " ", "ip", "call", "x.com", "$", "/", "4111 1111 1111 1111", "+1 (456) 555-2186", "10.0.0.1", "K"]


def plain_features(s, text, start, end, before):
    digits = re.sub("[^0-9]", "", s)
    on = ["bias", *(k for k, rx in pii._SHAPES.items() if rx.fullmatch(s))]
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts):
        on.append("parts under 256")
    if 13 <= len(digits) <= 19:
        on += ["13 to 19 digits", "luhn" if pii.luhn(digits) else "no luhn"]
    if 7 <= len(digits) <= 15:
        on.append("9 to 15 digits" if len(digits) > 8 else "7 or 8 digits")
    if start and (text[start - 1].isalnum() or text[start - 1] in "@._%+-$/"):
        on.append("glued left")
    if end < len(text) and (text[end].isalnum() or text[end] in "@_%/" or text[end] in "-." and end + 1 < len(text) and text[end + 1].isalnum()):
        on.append("glued right")
    if any(c.isalpha() for c in s):
        on.append("letters")
    on += [k for k, words in pii._CUES.items() if before in words]
    return [pii._INDEX[k] for k in on]


def texts(count, seed, longest=40):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(1, longest))) for _ in range(count)]


def test_features_match_the_plain_version():
    seen = 0
    for text in texts(400, 1):
        masked = pii.Masked(text)
        tokens, ends = pii.candidates(text)
        for j, found in enumerate(ends):
            for i, f in found:
                a, b = tokens[i][0], tokens[j][1]
                before = text[slice(*tokens[i - 1])].lower() if i else ""
                if before in (":", "=", "#") and i > 1:
                    before = text[slice(*tokens[i - 2])].lower()
                want = plain_features(text[a:b], text, a, b, before)
                assert f == want == pii.span_features(text, a, b, before)
                assert masked.shapes(a, b) == pii._alike(text[a:b])
                seen += 1
    assert seen > 3000


def test_best_segmentation_of_all():
    """``decode`` and ``find`` against an enumeration of all segmentations of short texts."""
    model = pii.trained()
    r = random.Random(5)
    noisy = pii.SemiCRF(model.weights + np.random.default_rng(3).normal(0, 1.5, model.weights.shape), 0.7)
    done = 0
    for text in texts(300, 2, 14) + [f"{r.choice(('tel', 'ip', ''))} {a} {b}" for a in ("10.0.0.1", "+1 (456) 555-2186") for b in ("4111 1111 1111 1111", "1.2.3.4")]:
        for m in (model, noisy):
            tokens, ends = pii.candidates(text)
            segments = [(i, j + 1, float(m.weights[f].sum(0).max())) for j, e in enumerate(ends) for i, f in e]
            if not segments or len(segments) > 14:
                continue

            def best(at, typed, tokens=tokens, segments=segments, m=m):
                """The best score from a token on; ``typed``: whether a typed segment ends just before."""
                if at == len(tokens):
                    return 0.0
                return max([best(at + 1, False), *(s + m.follow * typed + best(b, True) for a, b, s in segments if a == at)])

            for found in (m.decode(text), m.find(text)):
                score, end = 0.0, -1
                for k, a, b in sorted(found, key=lambda s: s[1]):
                    i, j = next(i for i, t in enumerate(tokens) if t[0] == a), next(j for j, t in enumerate(tokens) if t[1] == b)
                    f = next(f for x, f in ends[j] if x == i)
                    score += float(m.weights[f][:, k].sum()) + m.follow * (i == end)
                    end = j + 1
                assert score == pytest.approx(best(0, False), abs=1e-6)
            done += 1
    assert done > 60


def test_dense_texts_take_time_in_proportion():
    model = pii.trained()
    for unit in ("1.2.", "1 ", "12,345 678.90\n", "10.0.0.1 "):
        took = []
        for n in (5_000, 20_000):
            text = unit * (n // len(unit))
            began = time.perf_counter()
            model.find(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * max(took[0], 0.02) and took[1] / 20_000 < 80e-6
    text = "ip 1.2.3.4, " * 50
    assert model.find(text) == model.decode(text)
