"""A small gated recurrent network over word numbers, with a class-factored output, in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WINDOW = 32        # steps between which the state is carried, and over which gradients go back
PIECE = 64 * WINDOW  # a longer text goes on in another lane when it is learned; it is scored as one


def _softmax(x: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares of each row, in the memory of ``x``, and the logs of those at ``place``."""
    x -= np.ascontiguousarray(x.T).max(0)[:, None]      # the largest of whole rows at once
    logs = x[np.arange(len(x)), place]
    np.exp(x, out=x)
    sums = x.sum(-1, keepdims=True)
    logs -= np.log(sums[:, 0])
    x /= sums
    return x, logs


def _log_share_at(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """As ``_softmax``, the logs alone."""
    x -= np.ascontiguousarray(x.T).max(0)[:, None]
    logs = x[np.arange(len(x)), place]
    return logs - np.log(np.exp(x, out=x).sum(-1))


def _stable_order(numbers: np.ndarray, most: int) -> np.ndarray:
    """Order of numbers below ``most``; two bytes are sorted by their digits."""
    return np.argsort(numbers.astype(np.uint16) if most <= 1 << 16 else numbers, kind="stable")


class Network:
    """Parameters by name.  Words of one class stand next to each other; ``edges`` are the classes' borders.

    The probability of a word is that of its class times that of the word in its class, so
    a step costs about twice the root of the vocabulary.  With ``counts`` the network starts
    from the words' shares.
    """

    def __init__(self, edges: list[int], width: int = 16, seed: int = 7, counts: np.ndarray | None = None):
        rng, size = np.random.default_rng(seed), edges[-1]
        self.edges, self.width = np.array(edges), width
        self.class_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
        self.p = {
            "in": draw(size, 3 * width), "rec": draw(width, 3 * width), "bias": np.zeros(3 * width, np.float32),
            "class": draw(width, len(edges) - 1), "class_bias": np.zeros(len(edges) - 1, np.float32),
            "word": draw(size, width), "word_bias": np.zeros(size, np.float32),
        }
        if counts is not None:
            logs = np.log(np.asarray(counts, float) + 1)
            sums = np.log(np.add.reduceat(np.exp(logs), self.edges[:-1]))
            self.p["class_bias"], self.p["word_bias"] = sums.astype(np.float32), logs.astype(np.float32)
            self.p["class"] *= 0.1
            self.p["word"] *= 0.1

    def flat(self) -> np.ndarray:
        """All parameters in one row, in order of their names."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k], at = flat[at:at + n].reshape(self.p[k].shape).astype(np.float32), at + n
        return self

    def states(self, before: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """States after each column of ``before``, (steps + 1, rows, width), the first being ``state``, and gates (reset and keep beside each other), new values, inner sums of each step."""
        w, steps, bias = self.width, before.shape[1], self.p["bias"]
        inputs = self.p["in"][before.T]
        gates, new, inner = (np.empty((steps, *more, *state.shape), np.float32) for more in ((2,), (), ()))
        np.add(inputs[:, :, :w], bias[:w], out=gates[:, 0])
        np.add(inputs[:, :, w:2 * w], bias[w:2 * w], out=gates[:, 1])
        np.add(inputs[:, :, 2 * w:], bias[2 * w:], out=new)
        np.negative(gates, out=gates)                    # of the sums, so that the steps need not
        rec = np.ascontiguousarray(self.p["rec"].reshape(w, 3, w).transpose(1, 0, 2))
        to_gates, to_inner = -rec[:2], rec[2]
        out, sums, part = np.empty((steps + 1, *state.shape), np.float32), np.empty((2, *state.shape), np.float32), np.empty(state.shape, np.float32)
        out[0] = state
        for t in range(steps):
            h, g, n = out[t], gates[t], new[t]
            np.matmul(h, to_inner, out=inner[t])
            np.matmul(h, to_gates, out=sums)
            g += sums
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[0], inner[t], out=part)
            n += part
            np.tanh(n, out=n)
            np.subtract(h, n, out=part)
            part *= g[1]
            np.add(n, part, out=out[t + 1])
        return out, (gates, new, inner)

    def _by_class(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Order by class, places of the ordered words in their classes, and (class, begin, end) of the ordered ones, but of classes of one word."""
        classes = self.class_of[words]
        order = _stable_order(classes, len(self.edges))
        bounds = np.searchsorted(classes[order], np.arange(len(self.edges)))
        some = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(self.edges) > 1))
        return order, words[order] - self.edges[classes[order]], [(c, bounds[c], bounds[c + 1]) for c in some]

    def log_probabilities(self, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word after the state of its row."""
        out = _log_share_at(state @ self.p["class"] + self.p["class_bias"], self.class_of[words])
        order, place, found = self._by_class(words)
        h, more = state[order], np.zeros(len(words), out.dtype)
        for c, x, y in found:
            a, b = self.edges[c], self.edges[c + 1]
            more[x:y] = _log_share_at(h[x:y] @ self.p["word"][a:b].T + self.p["word_bias"][a:b], place[x:y])
        out[order] += more
        return out

    def score(self, texts: list[np.ndarray], start: int, rows: int = 1024) -> np.ndarray:
        """Log likelihood of each whole sequence: windows in lockstep, the state carried from one to the next.

        Texts go in by length, so those of one group end together; memory holds one window of a group.
        """
        out = np.zeros(len(texts))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), rows):
            group = order[at:at + rows]
            every, long = np.concatenate([texts[i] for i in group]), size[group]
            place = np.cumsum(long) - long
            state = np.zeros((len(group), self.width), np.float32)
            last = np.full(len(group), start)
            for begin in range(0, int(long[0]), WINDOW):
                live = int((long > begin).sum())     # the longest stand first
                group, long, place, state, last = group[:live], long[:live], place[:live], state[:live], last[:live]
                steps = min(WINDOW, int(long[0]) - begin)
                step = begin + np.arange(steps)
                real = step < long[:, None]
                words = np.where(real, every[np.minimum(place[:, None] + step, len(every) - 1)], start)
                before = np.concatenate((last[:, None], words[:, :-1]), 1)
                states, _ = self.states(before, state)
                flat = real.T.ravel()
                logs = np.zeros(len(flat))
                logs[flat] = self.log_probabilities(states[1:].reshape(-1, self.width)[flat], words.T.ravel()[flat])
                out[group] += logs.reshape(steps, live).sum(0)
                state, last = states[-1], words[:, -1]
        return out

    def gradient(self, before: np.ndarray, words: np.ndarray, state: np.ndarray, real: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean loss over one window, the state behind it, and the loss; nothing flows further back.

        Places that are not ``real`` (behind the end of a lane) count nothing.
        """
        p, w = self.p, self.width
        rows, steps = words.shape
        states, kept = self.states(before, state)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        taken = np.arange(words.size) if real is None else np.flatnonzero(real.T.ravel())
        h, flat = states[1:].reshape(-1, w)[taken], words.T.ravel()[taken]
        n, classes = len(flat), self.class_of[flat]
        d, logs = _softmax(h @ p["class"] + p["class_bias"], classes)
        loss = -logs.sum()
        d[np.arange(n), classes] -= 1
        g["class"], g["class_bias"], dh = h.T @ d, d.sum(0), d @ p["class"].T
        order, place, found = self._by_class(flat)
        h, more = h[order], np.zeros((n, w), dh.dtype)
        for c, x, y in found:
            a, b = self.edges[c], self.edges[c + 1]
            d, logs = _softmax(h[x:y] @ p["word"][a:b].T + p["word_bias"][a:b], place[x:y])
            loss -= logs.sum()
            d[np.arange(y - x), place[x:y]] -= 1
            g["word"][a:b], g["word_bias"][a:b] = d.T @ h[x:y], d.sum(0)
            more[x:y] = d @ p["word"][a:b]
        dh[order] += more
        if n < words.size:
            whole = np.zeros((words.size, w), dh.dtype)
            whole[taken] = dh
            dh = whole
        dh = dh.reshape(steps, rows, w)
        gates, new, inner = kept
        reset, keep = gates[:, 0], gates[:, 1]
        to_new = (1 - keep) * (1 - new * new)
        to_keep, to_reset = (states[:-1] - new) * keep * (1 - keep), inner * reset * (1 - reset)
        carry = np.zeros((rows, w), np.float32)
        drecs, dnews = np.empty((steps, rows, 3 * w), np.float32), np.empty((steps, rows, w), np.float32)
        back = np.ascontiguousarray(p["rec"].T)
        for t in range(steps - 1, -1, -1):
            total, drec, dnew = dh[t], drecs[t], dnews[t]
            total += carry
            np.multiply(total, to_new[t], out=dnew)
            np.multiply(dnew, to_reset[t], out=drec[:, :w])
            np.multiply(total, to_keep[t], out=drec[:, w:2 * w])
            np.multiply(dnew, reset[t], out=drec[:, 2 * w:])
            np.multiply(total, keep[t], out=carry)
            carry += drec @ back
        g["rec"] = states[:-1].reshape(-1, w).T @ drecs.reshape(-1, 3 * w)
        drecs[:, :, 2 * w:] = dnews                      # from here on the gradients of the inputs
        dins, inputs = drecs.reshape(-1, 3 * w), before.T.ravel()
        g["bias"] = dins.sum(0)
        order = _stable_order(inputs, len(p["in"]))
        inputs = inputs[order]
        first = np.flatnonzero(np.concatenate(([True], inputs[1:] != inputs[:-1])))
        g["in"][inputs[first]] = np.add.reduceat(dins[order], first)
        return {k: v / n for k, v in g.items()}, states[-1], float(loss / n)

    def train(self, texts: Iterable[np.ndarray], start: int, rows: int = 128, rate: float = 0.01) -> int:
        """Adam over windows of all texts, read once, one after the other; returns the number of tokens.

        Each of ``rows`` lanes takes the next text when its own ends, so memory holds one text
        (or piece of a long one) a lane.  When no text is left the lanes run out one by one.
        """
        pieces = ((t[i - 1] if i else start, t[i:i + PIECE]) for t in texts for i in range(0, len(t), PIECE))
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        lanes: list[list] = [[start, np.zeros(0, np.int32)] for _ in range(rows)]      # the word before, and what is left
        state, done, i = np.zeros((rows, self.width), np.float32), 0, 0
        while True:
            for lane in lanes:
                while len(lane[1]) < WINDOW and (piece := next(pieces, None)) is not None:
                    if not len(lane[1]):
                        lane[0] = piece[0]
                    lane[1] = np.concatenate((lane[1], piece[1]))
            live = [r for r, lane in enumerate(lanes) if len(lane[1])]
            if not live:
                return done
            if len(live) < len(lanes):
                lanes, state = [lanes[r] for r in live], state[live]
            last = np.array([lane[0] for lane in lanes])
            if min(len(lane[1]) for lane in lanes) >= WINDOW:
                words, real = np.concatenate([lane[1][:WINDOW] for lane in lanes]).reshape(len(lanes), WINDOW).astype(np.int64), None
            else:
                words, real = np.full((len(lanes), WINDOW), start), np.zeros((len(lanes), WINDOW), bool)
                for r, (_, left) in enumerate(lanes):
                    part = left[:WINDOW]
                    words[r, :len(part)], real[r, :len(part)] = part, True
            before = np.concatenate((last[:, None], words[:, :-1]), 1)
            if real is not None:
                before = np.where(real, before, start)
            lanes = [[left[min(len(left), WINDOW) - 1], left[WINDOW:]] for _, left in lanes]
            g, state, _ = self.gradient(before, words, state, real)
            done, i = done + (words.size if real is None else int(real.sum())), i + 1
            for k, x in g.items():
                step = x - m[k]
                step *= 0.1
                m[k] += step
                np.multiply(x, x, out=step)
                step -= v[k]
                step *= 0.01
                v[k] += step
                np.divide(v[k], 1 - 0.99 ** i, out=step)
                np.sqrt(step, out=step)
                step += 1e-8
                np.divide(m[k], 1 - 0.9 ** i, out=x)
                x *= rate
                x /= step
                self.p[k] -= x
