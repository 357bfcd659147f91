"""A character-level bidirectional LSTM with CRF transitions, in numpy, and its training spans."""

from __future__ import annotations

from functools import lru_cache
from random import Random

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Character classes: printable ASCII each, then white space, other letters, the rest, and padding.
CLASSES = 95 + 4
PAD = CLASSES - 1
WINDOW, STRIDE = 64, 32


def classes(text: str | np.ndarray) -> np.ndarray:
    """The class of each code point."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) if isinstance(text, str) else text
    out = np.full(len(code), 97, dtype=np.uint8)
    out[code < 0x2000] = 96
    plain = (code >= 32) & (code < 127)
    out[plain] = code[plain] - 32
    out[code < 32] = 95
    return out


def allowed() -> np.ndarray:
    """0 for transitions that the tags permit, else a large negative number: I follows B or I of its kind."""
    out = np.zeros((TAGS + 1, TAGS))  # the last row is the start
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Parameters: for each direction input (classes, 4h), recurrent (h, 4h); output (2h, tags); transitions."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = h = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p["r" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p["x" + d][:, h : 2 * h] += 1  # forget gates start open
        self.p["o"] = rng.normal(0, 0.3, (2 * h, TAGS))
        self.p["c"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS + 1, TAGS))
        self.mask = allowed()

    def run(self, ids: np.ndarray, d: str, keep: bool = False):
        """Hidden states (time, batch, h) of one direction; with ``keep`` what its gradient needs."""
        h, n, steps = self.h, len(ids), ids.shape[1]
        x, r = self.p["x" + d], self.p["r" + d]
        state, cell, out, kept = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype), np.empty((steps, n, h), x.dtype), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = x[ids[:, t]] + state @ r
            gates = sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, prior = state, cell
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = out[t] = o * squashed
            if keep:
                kept[t] = (before, prior, i, f, o, new, squashed)
        return (out, kept) if keep else out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(ids, "f"), self.run(ids, "b")], axis=2) @ self.p["o"] + self.p["c"]

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        n, steps = ids.shape
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        states = {d: self.run(ids, d, True) for d in "fb"}
        both = np.concatenate([states["f"][0], states["b"][0]], axis=2)
        e = both @ self.p["o"] + self.p["c"]
        step = (self.p["t"] + self.mask)[:-1]
        start = (self.p["t"] + self.mask)[-1]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + start
        for t in range(1, steps):
            alpha[t] = e[t] + logsum(alpha[t - 1][:, :, None] + step[None], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = logsum(step[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = logsum(alpha[-1], 1)
        de = np.exp(alpha + beta - total[None, :, None])
        rows = np.arange(n)
        gold = start[tags[:, 0]] + e[0][rows, tags[:, 0]]
        g["t"][-1] = de[0].sum(0)
        np.add.at(g["t"][-1], tags[:, 0], -1)
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + step[None] + (e[t] + beta[t])[:, None, :] - total[:, None, None])
            g["t"][:-1] += pair.sum(0)
            np.add.at(g["t"], (tags[:, t - 1], tags[:, t]), -1)
            gold += step[tags[:, t - 1], tags[:, t]] + e[t][rows, tags[:, t]]
        for t in range(steps):
            de[t][rows, tags[:, t]] -= 1
        g["o"], g["c"] = np.tensordot(both, de, ((0, 1), (0, 1))), de.sum((0, 1))
        back, h = de @ self.p["o"].T, self.h
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            r, kept = self.p["r" + d], states[d][1]
            ds, dc = np.zeros((n, h)), np.zeros((n, h))
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                before, prior, i, f, o, new, squashed = kept[t]
                ds = ds + part[t]
                dc = dc + ds * o * (1 - squashed**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * prior * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
                one = np.zeros((n, CLASSES))
                one[rows, ids[:, t]] = 1
                g["x" + d] += one.T @ dz
                g["r" + d] += before.T @ dz
                ds, dc = dz @ r.T, dc * f
        return float((total - gold).mean()), {k: v / n for k, v in g.items()}

    def decode(self, ids: np.ndarray, taggable: np.ndarray | None = None) -> np.ndarray:
        """The best tag sequence of each row of classes (Viterbi); where not ``taggable``, only outside is allowed."""
        e = self.emissions(ids)
        if taggable is not None:
            e[~taggable.T, 1:] = -1e4
        step = (self.p["t"] + self.mask)[:-1]
        best = e[0] + (self.p["t"] + self.mask)[-1]
        back = np.empty(e.shape, dtype=np.int8)
        for t in range(1, len(e)):
            score = best[:, :, None] + step[None]
            back[t] = score.argmax(1)
            best = score.max(1) + e[t]
        out = np.empty(ids.shape, dtype=np.int8)
        out[:, -1] = best.argmax(1)
        rows = np.arange(len(ids))
        for t in range(len(e) - 1, 0, -1):
            out[:, t - 1] = back[t][rows, out[:, t]]
        return out


def _digits(rng: Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _word(rng: Random, low: int = 2, high: int = 10) -> str:
    return "".join(rng.choices("abcdefghijklmnoprstuvwyzäéñ", k=rng.randrange(low, high)))


def _card(rng: Random) -> str:
    body = rng.choice("345") + _digits(rng, 14)
    check = next(c for c in "0123456789" if luhn(body + c))
    return rng.choice(["", "", " ", "-", ".", "/"]).join((body + check)[k : k + 4] for k in range(0, 16, 4))


def _phone(rng: Random) -> str:
    a, b, c, d = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), _digits(rng, 2)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"00{d} {a} {b}{c}", f"{a}.{b}.{c}"])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


#: Makers of spans by kind; those of no kind look alike but aren't personal.
MAKERS = (
    (0, lambda r: f"{_word(r)}.{_digits(r, 2)}@{_word(r)}{_digits(r, 1)}.{_word(r)}.com"),
    (0, lambda r: f"{_word(r)}{r.choice(['_', '+', ''])}{_word(r)}@{_word(r, 3)}.{r.choice(['org', 'net', 'de', 'fr'])}"),
    (1, lambda r: ".".join(str(r.randrange(256)) for _ in range(4))),
    (2, _card),
    (3, _phone),
    (3, _phone),
    (None, lambda r: f"{_digits(r, 1)}.{_digits(r, 1)}"),
    (None, lambda r: f"{r.randrange(1900, 2030)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}"),
    (None, lambda r: "".join(r.choices("0123456789abcdef", k=r.randrange(12, 41)))),
    (None, lambda r: "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))),
    (None, lambda r: _digits(r, r.randrange(1, 24))),
    (None, lambda r: f"{_digits(r, 2)},{_digits(r, 3)}.{_digits(r, 2)}"),
    (None, lambda r: ".".join(str(r.randrange(30)) for _ in range(3))),
    (None, lambda r: f"@{_word(r)}"),
)


def example(rng: Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text of about three windows, and its labelled spans (start, end, kind)."""
    text, spans = "", []
    for _ in range(rng.randrange(2, 5)):
        text += "".join(_word(rng) + rng.choice(["", "", "", ",", ".", ".\n"]) + " " for _ in range(rng.randrange(1, 7)))
        kind, make = rng.choice(MAKERS)
        piece = make(rng)
        if kind is not None:
            spans.append((len(text), len(text) + len(piece), kind))
        text += piece + rng.choice([" ", " ", ". ", ", ", ")\n"])
    return text, spans


def labelled_windows(rng: Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of ``n`` windows cut anywhere out of examples."""
    ids, tags = np.full((n, WINDOW), PAD), np.zeros((n, WINDOW), dtype=np.int64)
    for i in range(n):
        text, spans = example(rng)
        own = np.zeros(len(text), dtype=np.int64)
        for a, b, k in spans:
            own[a], own[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
        a = rng.randrange(max(1, len(text) - WINDOW // 2))
        cut = own[a : a + WINDOW].copy()
        if cut[0] and cut[0] % 2 == 0:  # a span that began before the window
            cut[0] -= 1
        ids[i, : len(cut)], tags[i, : len(cut)] = classes(text)[a : a + WINDOW], cut
    return ids, tags


@lru_cache(maxsize=2)
def trained(hidden: int = 16, steps: int = 220, batch: int = 96, seed: int = 7) -> Tagger:
    """A tagger trained with Adam on generated labelled spans; the same for the same parameters."""
    rng = Random(seed)
    model = Tagger(hidden, np.random.default_rng(seed))
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        _, g = model.gradient(*labelled_windows(rng, batch))
        norm = np.sqrt(sum((x * x).sum() for x in g.values()))
        rate = 0.03 * (1 - t / (steps + 1)) + 0.002
        for k in model.p:
            x = g[k] * min(1, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            model.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float32)
    return model
