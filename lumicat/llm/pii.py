"""Personal data by a semi-Markov conditional random field over token segments, beside fixed base patterns.

Whole-span features score each candidate segment of up to ``LONGEST`` tokens; dynamic programming over segmentations
chooses boundaries and types jointly.  A segment of a type needs a trigger (a digit or an at-sign, also a spelled one), so
text ``LONGEST`` tokens away from triggers can only be untyped.  What is scored there too low to win falls out, and the
best segmentation of the whole text falls apart at tokens that no other candidate covers (``SemiCRF.find``).
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import HELD, bound_batches, lean, slices, texts

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a typed segment at most.
LONGEST = 16
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.I)
#: With the weak ones: "at" after a bracket or a space.
_ANY_TRIGGER = re.compile(r"[0-9@]|(?<=[\[({ ])at(?![A-Za-z])|[\[({]\s?at\s?[\])}]", re.I | re.A)
#: Tokens before a trigger that matter: the longest segment that ends with it and two for the cue.
_BEFORE = LONGEST + 1

# ---- base patterns: fixed


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; each kind leftmost and non-overlapping.

    The patterns are searched from their rarest character or only at the start of a run, which finds the same matches
    and keeps the time linear in texts without any.
    """
    out = []
    if "@" in text:
        after = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > after and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                after = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x[-4:]) < 256 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


# ---- the model

#: Whole-span features: name -> what the span matches.
_SHAPES = {
    "address": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "spelled": re.compile(r"[A-Za-z0-9._%+-]+(?:@|\s?[\[({]\s?at\s?[\])}]\s?)[A-Za-z0-9-]+(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z]{2,})+", re.I),
    "quad": re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
    "spread quad": re.compile(r"[0-9]{1,3}(?:\s?[\[(]\.[\])]\s?[0-9]{1,3}){3}"),
    "grouped": re.compile(r"[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}"),
    "run": re.compile(r"[0-9]+"),
    "plus": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
    "area": re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"),
    "trunk": re.compile(r"00[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,4}"),
    "dashed": re.compile(r"[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}"),
    "date": re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}"),
}
_FEATURES = ("bias", *_SHAPES, "parts under 256", "luhn", "no luhn", "13 to 19 digits", "9 to 15 digits", "7 or 8 digits", "glued left", "glued right", "letters", "cue email", "cue ip", "cue card", "cue phone")
_CUES = {"cue email": {"mail", "email", "contact", "write"}, "cue ip": {"ip", "host", "server", "address"}, "cue card": {"card", "visa", "credit", "pay"}, "cue phone": {"phone", "call", "tel", "mobile", "fax"}}


_SAME_DIGIT = str.maketrans("0123456789", "1" * 10)


@lru_cache(maxsize=1 << 16)
def _alike(s: str) -> tuple[str, ...]:
    """The shapes that ``s`` matches."""
    return tuple(k for k, rx in _SHAPES.items() if rx.fullmatch(s))


HELD["shapes"] = _alike.cache_clear


class Masked:
    """A text with all digits alike, made when it is first asked for: most texts have no candidate."""

    def __init__(self, text: str):
        self.text, self.made = text, None

    def shapes(self, start: int, end: int) -> tuple[str, ...]:
        """The shapes of text[start:end].  Beyond its first three characters no shape looks at which digit stands where, so
        spans with digits in the same places share one answer."""
        if self.made is None:
            self.made = self.text.translate(_SAME_DIGIT)
        return _alike(self.text[start : min(start + 3, end)] + self.made[start + 3 : end])


def span_features(text: str, start: int, end: int, before: str, shapes: tuple[str, ...] | None = None) -> list[int]:
    """Indices of the features of text[start:end] as one segment; ``before``: the word before it; ``shapes``: what it matches,
    where that is known."""
    s = text[start:end]
    shapes = _alike(s) if shapes is None else shapes
    on = ["bias", *shapes]
    # four parts of up to three digits each are what the shape says
    if "quad" in shapes and all(int(p) < 256 for p in s.split(".")):
        on.append("parts under 256")
    n = s.translate(_SAME_DIGIT).count("1")
    if 13 <= n <= 19:
        on.append("13 to 19 digits")
        on.append("luhn" if luhn("".join(c for c in s if c in "0123456789")) else "no luhn")
    if 9 <= n <= 15:
        on.append("9 to 15 digits")
    elif 7 <= n <= 8:
        on.append("7 or 8 digits")
    if start and (text[start - 1].isalnum() or text[start - 1] in "@._%+-$/"):
        on.append("glued left")
    if end < len(text) and (text[end].isalnum() or text[end] in "@_%/" or text[end] in "-." and end + 1 < len(text) and text[end + 1].isalnum()):
        on.append("glued right")
    if any(c.isalpha() for c in s):
        on.append("letters")
    on += [k for k, words in _CUES.items() if before in words]
    return [_INDEX[k] for k in on]


_INDEX = {k: i for i, k in enumerate(_FEATURES)}


def candidates(text: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, list[int]]]]]:
    """Tokens of ``text``, and for each end the typed candidate segments (first token, features) that end there."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    digit = np.cumsum([0, *(_digits(text, a, b) for a, b in tokens)]).tolist()
    mark = np.cumsum([0, *(_mark(text, a, b) for a, b in tokens)]).tolist()
    masked = Masked(text)
    return tokens, [list(_ending(text, masked, tokens, digit, mark, j)) for j in range(len(tokens))]


def _digits(text: str, a: int, b: int) -> int:
    return b - a if "0" <= text[a] <= "9" else 0


def _mark(text: str, a: int, b: int) -> bool:
    return text[a] == "@" or b - a == 2 and text[a:b].lower() == "at" and a > 0 and text[a - 1] in "[({ "


def _ending(text: str, masked: Masked, tokens: list[tuple[int, int]], digit: list[int], mark: list[int], j: int, bare: bool = True) -> Iterator[tuple[int, list[int]]]:
    """The candidates that end with token j, shortest first; ``digit`` and ``mark`` count those before each token.  ``bare``: also
    those that match no shape."""
    if digit[j + 1] - digit[max(0, j + 1 - LONGEST)] < 4 and mark[j + 1] == mark[max(0, j + 1 - LONGEST)]:
        return
    broken, end = False, tokens[j][1]
    for i in range(j, max(-1, j - LONGEST), -1):
        n, start = digit[j + 1] - digit[i], tokens[i][0]
        if n > 24:
            break
        broken = broken or i < j and "\n" in text[tokens[i][1] : tokens[i + 1][0]]
        if not (4 <= n and (n >= 7 or j - i >= 6) or mark[j + 1] - mark[i] == 1 and j - i >= 4):
            continue
        if broken and start and i:
            break
        shapes = masked.shapes(start, end)
        if not shapes and not bare:
            continue
        before = text[slice(*tokens[i - 1])].lower() if i else ""
        if before in (":", "=", "#") and i > 1:
            before = text[slice(*tokens[i - 2])].lower()
        f = span_features(text, start, end, before, shapes)
        if len(f) > 1:
            yield i, f


class SemiCRF:
    """weights: features x kinds; an untyped token scores 0.  ``follow``: score of a typed segment right after another."""

    def __init__(self, weights: np.ndarray | None = None, follow: float = 0.0):
        self.weights = np.zeros((len(_FEATURES), len(KINDS))) if weights is None else weights
        self.follow = follow
        self._known: dict[tuple[int, ...], tuple[int, float]] = {}
        self._known_of = self.weights.copy()

    def _best_kind(self, features: list[int]) -> tuple[int, float]:
        """The kind that scores most with some features, and its score; the same few sets of features come again and again."""
        key = tuple(features)
        if (got := self._known.get(key)) is None:
            w = self.weights[features].sum(0)
            got = self._known[key] = (k := int(w.argmax()), float(w[k]))
        return got

    def _without_shape(self) -> np.ndarray:
        """The most that a segment without any shape can score, by kind."""
        w = lambda *names: self.weights[[_INDEX[k] for k in names]]
        many = w("9 to 15 digits")[0].clip(0) + w("13 to 19 digits")[0] + w("luhn", "no luhn").max(0)
        digits = np.max([many, w("9 to 15 digits")[0], w("7 or 8 digits")[0]], axis=0).clip(0)
        return w("bias")[0] + digits + w("glued left", "glued right", "letters").clip(0).sum(0) + w(*_CUES).clip(0).sum(0)

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the typed segments of the best segmentation."""
        tokens, ends = candidates(text)
        if not any(ends):
            return []
        n = len(tokens)
        # best score of tokens before j, ending untyped (0) or typed (1), with the step that led there
        best = [[0.0, -1e30]]
        back: list[tuple] = [(None, None)]
        for j in range(n):
            free = 0 if best[j][0] >= best[j][1] else 1
            score, step = [best[j][free], -1e30], [(j, free, -1), None]
            for i, f in ends[j]:
                w = self.weights[f].sum(0)
                k = int(w.argmax())
                last = 0 if best[i][0] >= best[i][1] + self.follow else 1
                got = float(w[k]) + best[i][last] + self.follow * last
                if got > score[1]:
                    score[1], step[1] = got, (i, last, k)
            best.append(score)
            back.append(tuple(step))
        out, j, state = [], n, 0 if best[n][0] >= best[n][1] else 1
        while j:
            i, last, k = back[j][state]
            if k >= 0:
                out.append((k, tokens[i][0], tokens[j - 1][1]))
            j, state = i, last
        return out[::-1]

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """What ``decode`` finds, in time and memory that follow the triggers and not the length of the text.

        A segment can only win with more than ``-2 * follow``: else its tokens are better untyped.  Tokens are read from
        ``_BEFORE`` in front of a trigger until none can belong to a segment with a trigger.
        """
        if not np.array_equal(self._known_of, self.weights):
            self._known, self._known_of = {}, self.weights.copy()
        least, masked = -2 * max(0.0, self.follow), Masked(text)
        bare = self._without_shape().max() >= least
        # a segment around a mere "at" has no other features than these
        few = self.weights[[_INDEX[k] for k in ("bias", "letters")]].sum(0) + self.weights[[_INDEX[k] for k in ("glued left", "glued right")]].clip(0).sum(0)
        few += self.weights[[_INDEX[k] for k in _CUES]].max(0).clip(0)
        trigger = _TRIGGER if few.max() < least else _ANY_TRIGGER
        out, floor, m = [], 0, trigger.search(text)
        while m:
            # base: number of tokens[0]; held: segments that may touch later ones; far: tokens since the last trigger
            tokens, digit, mark, base, held, far = [], [0], [0], 0, [], 0
            at = last = m.start()
            for t in _TOKEN.finditer(text, _back(text, at, floor)):
                a, b = t.span()
                tokens.append((a, b))
                digit.append(digit[-1] + _digits(text, a, b))
                mark.append(mark[-1] + _mark(text, a, b))
                j = len(tokens) - 1
                if held and base + j - LONGEST > held[-1][1]:
                    out += self._best(held)
                    held = []
                for i, f in _ending(text, masked, tokens, digit, mark, j, bare):
                    k, score = self._best_kind(f)
                    if score >= least:
                        held.append((base + i, base + j, k, score, tokens[i][0], b))
                if a >= at and (digit[-1] > digit[-2] or mark[-1] > mark[-2] or a == at):
                    far, last = 0, b
                elif a > at:
                    far += 1
                    if far > LONGEST + _BEFORE:
                        break
                if j > 4096:
                    base += j + 1 - 2 * LONGEST
                    del tokens[: -2 * LONGEST], digit[: -2 * LONGEST - 1], mark[: -2 * LONGEST - 1]
            out += self._best(held)
            floor = last
            m = trigger.search(text, a) if far > LONGEST + _BEFORE else None  # not from b: a bracket may come before "at"
        return out

    def _best(self, held: list[tuple[int, int, int, float, int, int]]) -> list[tuple[int, int, int]]:
        """The best choice of segments (first and last token, kind, score, start, end), which come by their last token."""
        if not held:
            return []
        first = min(s[0] for s in held)
        best: list[tuple[float, float]] = [(0.0, -1e30)]
        back: list[tuple] = [(None, None)]
        at = 0
        for j in range(held[-1][1] + 1 - first):
            free = 0 if best[j][0] >= best[j][1] else 1
            score, step = -1e30, None
            while at < len(held) and held[at][1] == first + j:
                s = held[at]
                before = best[s[0] - first]
                last = 0 if before[0] >= before[1] + self.follow else 1
                got = s[3] + before[last] + self.follow * last
                if got > score:
                    score, step = got, (last, s)
                at += 1
            best.append((best[j][free], score))
            back.append(((free, None), step))
        out, j = [], len(best) - 1
        state = 0 if best[j][0] >= best[j][1] else 1
        while j:
            state, s = back[j][state]
            if s:
                out.append((s[2], s[4], s[5]))
            j = s[0] - first if s else j - 1
        return out[::-1]

    def gradient(self, text: str, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, float, float]:
        """Gradient of the log-likelihood by forward and backward sums over segmentations."""
        tokens, ends = candidates(text)
        n = len(tokens)
        w = [[(i, f, self.weights[f].sum(0)) for i, f in e] for e in ends]
        fwd = np.full((n + 1, 2), -np.inf)
        fwd[0, 0] = 0
        for j in range(n):
            fwd[j + 1, 0] = np.logaddexp(*fwd[j])
            for i, _, s in w[j]:
                fwd[j + 1, 1] = np.logaddexp(fwd[j + 1, 1], np.logaddexp(fwd[i, 0], fwd[i, 1] + self.follow) + np.logaddexp.reduce(s))
        bwd = np.full((n + 1, 2), -np.inf)
        bwd[n] = 0
        for j in range(n, 0, -1):
            bwd[j - 1] = np.logaddexp(bwd[j - 1], bwd[j, 0])
            for i, _, s in w[j - 1]:
                t = np.logaddexp.reduce(s) + bwd[j, 1]
                bwd[i, 0] = np.logaddexp(bwd[i, 0], t)
                bwd[i, 1] = np.logaddexp(bwd[i, 1], t + self.follow)
        z = np.logaddexp(*fwd[n])
        grad, gold_score, follow = np.zeros_like(self.weights), 0.0, 0.0
        gold_at = {(a, b): k for k, a, b in gold}
        gold_ends = {b for _, _, b in gold}
        for j in range(n):
            for i, f, s in w[j]:
                span = (tokens[i][0], tokens[j][1])
                p = np.exp(np.logaddexp(fwd[i, 0], fwd[i, 1] + self.follow) + s + bwd[j + 1, 1] - z)
                follow -= float(np.exp(fwd[i, 1] + self.follow + np.logaddexp.reduce(s) + bwd[j + 1, 1] - z))
                if (k := gold_at.get(span)) is not None:
                    p[k] -= 1
                    gold_score += s[k]
                    follow += bool(i) and tokens[i - 1][1] in gold_ends
                for x in f:
                    grad[x] -= p
        return grad, follow, float(gold_score - z)


def examples(count: int, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled lines: entities in usual and disguised forms, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(1, 8)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        d = r.choice("3456") + digits(r.choice((12, 14, 14, 14, 17)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if r.random() < 0.5 or len(d) != 16 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[int, str]:
        k = r.randrange(4)
        at, dot = r.choice((("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "[dot]")))
        quad = [str(r.randint(0, 255)) for _ in range(4)]
        local = f"{r.randint(200, 999)}{r.choice(('-', '.'))}{digits(3)}"
        phone = r.choice((f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{local[:3]}{local[3]}{digits(3)}{local[3]}{digits(4)}", f"00{r.randint(1, 99)} {digits(3)} {digits(4)} {digits(2)}"))
        return k, (f"{word()}.{digits(2)}{at}{word()}{r.randint(0, 9) if at == '@' else ''}{dot}{r.choice(('com', 'org', 'net'))}", r.choice((".", ".", "[.]")).join(quad), card(), phone)[k]

    def other() -> str:
        bad = digits(16)
        return r.choice((f"{r.randint(1, 30)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{r.randint(256, 999)}.{r.randint(0, 255)}.{digits(2)}.{digits(3)}", bad if not luhn(bad) else bad + "0", digits(r.randint(1, 8)), bad if not luhn(bad) else bad[1:] + "0", f"{digits(2)},{digits(3)}", digits(25), f"#{digits(7)}", f"{word()}{digits(5)}{word()}", f"@{word()}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{word()} at {word()}. {word()}", f"{digits(10)}", f"{digits(3)} {digits(3)} {digits(3)}"))

    cues = ("mail", "email", "ip", "server", "card", "visa", "phone", "call", "tel")
    for _ in range(count):
        text, gold = word(), []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                text += " " + (r.choice(cues) + r.choice(("", ":")) if r.random() < 0.3 else word())
            if r.random() < 0.5:
                k, e = entity()
                gold.append((k, len(text) + 1, len(text) + 1 + len(e)))
                text += " " + e
            else:
                text += " " + other()
            text += r.choice((" ", ", ", ". ")) + word()
        yield text, gold


@lru_cache(maxsize=1)
def trained(count: int = 600, rounds: int = 6) -> SemiCRF:
    """The model, trained on ``count`` generated lines by stochastic gradient steps on the log-likelihood."""
    model, lines = SemiCRF(), list(examples(count))
    power, follow_power = np.full_like(model.weights, 1e-3), 1e-3
    for _ in range(rounds):
        for text, gold in lines:
            g, follow, _ = model.gradient(text, gold)
            g -= 0.002 * model.weights
            power += g * g
            model.weights += 0.5 * g / np.sqrt(power)
            follow_power += follow * follow
            model.follow += 0.3 * follow / follow_power**0.5
    return model


def _back(text: str, at: int, floor: int) -> int:
    """Start of the token ``_BEFORE`` tokens before the one at ``at``, or ``floor``, where a token ends."""
    size = 160
    while True:
        lo = max(floor, at - size)
        # the first of them may be cut
        starts = [m.start() for m in _TOKEN.finditer(text, lo, at)][lo > floor :]
        if len(starts) >= _BEFORE:
            return starts[-_BEFORE]
        if lo == floor:
            return floor
        size *= 2


def all_spans(text: str, model: SemiCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the model's spans that overlap none of them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for k, a, b in model.find(text):
        at = bisect_left(taken, (b, 0))
        if not any(x < b and a < y for x, y in taken[max(0, at - 4) : at]):
            added.append((k, a, b))
    return base, sorted(added)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiCRF | None = None) -> DataFrame:
    """(doc_id, base, added): spans as kind:start:end (code points, end exclusive) in one array each, by kind and start.

    Null texts count as empty and have no spans; whole texts are searched; rows are searched one by one; an empty table
    gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda spans: [f"{KINDS[k]}:{a}:{b}" for k, a, b in spans]
        for batch in batches:
            for part in slices(batch):
                got = [all_spans(t, model.value) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([name(b) for b, _ in got], pa.list_(pa.string())), pa.array([name(a) for _, a in got], pa.list_(pa.string()))], names=["doc_id", "base", "added"])

    return texts(docs, id_col, text_col).mapInArrow(lean(run, "shapes"), "doc_id long, base array<string>, added array<string>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiCRF | None = None) -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in brackets; the longest of overlapping spans names
    the whole.  All columns stay; null texts stay null."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model or trained())
    schema, place = docs.schema, docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, added = all_spans(text, model.value)
        merged: list[list[int]] = []
        for k, a, b in sorted((*base, *added), key=lambda s: (s[1], -s[2])):
            if merged and a < merged[-1][2]:
                if b - a > merged[-1][3]:
                    merged[-1][0], merged[-1][3] = k, b - a
                merged[-1][2] = max(b, merged[-1][2])
            else:
                merged.append([k, a, b, b - a])
        out, at = [], 0
        for k, a, b, _ in merged:
            out += [text[at:a], f"[{KINDS[k]}]"]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = list(part.columns)
                cols[place] = pa.array([clean(t) for t in cols[place].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(lean(run, "shapes"), schema)
