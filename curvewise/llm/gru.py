"""A small gated recurrent language model in numpy with a class-factored output.

Tokens are numbered by falling frequency and cut into classes of equal size, so a token's
probability is that of its class times its share within the class. Before training the output
biases give the unigram model exactly; training can only start from there.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]

#: Tokens whose gradients are summed apart, since they are met the most.
COMMON = 16
#: States worked on together, so that the arrays at hand stay in the cache.
ROWS = 512


def new_params(log_p: np.ndarray, hidden: int, width: int) -> Params:
    """From unigram log probabilities (natural) of all tokens; `width` tokens to a class."""
    rng = np.random.default_rng(11)
    size = len(log_p)
    classes = -(-size // width)
    padded = np.full(classes * width, -1e9)
    padded[:size] = log_p
    table = padded.reshape(classes, width)
    top = table.max(axis=1, keepdims=True)
    mass = top[:, 0] + np.log(np.exp(table - top).sum(axis=1))
    scale = 1 / np.sqrt(hidden)
    p = {
        "embed": rng.normal(0, 0.3, (size, hidden)),
        "w": rng.normal(0, scale, (hidden, 3 * hidden)),
        "u": rng.normal(0, scale, (hidden, 3 * hidden)),
        "b": np.zeros(3 * hidden),
        "class_w": np.zeros((hidden, classes)),
        "class_b": mass,
        "word_w": np.zeros((classes, hidden, width)),
        "word_b": np.where(table < -1e8, -1e9, table - mass[:, None]),
    }
    p["b"][hidden : 2 * hidden] = 1.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def _exponentials(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of x, their sums over the last axis, and the log share of each entry `at`,
    counted through x.

    Numbers are shifted by the largest of their row only where the range of floats asks for it.
    """
    ones = np.ones(x.shape[-1], x.dtype)
    chosen = x.reshape(-1)[at]
    with np.errstate(over="ignore"):
        shares = np.exp(x)
    sums = shares @ ones
    if not (sums.max() < 1e30 and sums.min() > 1e-20):
        top = x.max(axis=-1)
        shares = np.exp(x - top[..., None])
        sums = shares @ ones
        chosen = chosen - top.reshape(-1)
    return shares, sums, chosen - np.log(sums.reshape(-1))


def output_log_p(p: Params, h: np.ndarray, target: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target after each state; with `grads`, adds the gradients of the
    summed negative log likelihood and returns that of the states too.

    States get a last entry of 1, so that biases are the last row of the weights.
    """
    (classes, width), (count, n) = p["word_b"].shape, h.shape
    order = np.argsort(target // width, kind="stable")  # states of one class lie together
    group, inside = np.divmod(target.take(order), width)
    ends = np.searchsorted(group, np.arange(classes + 1)).tolist()
    own = np.ones((count, n + 1), h.dtype)
    own[:, :n] = h.take(order, axis=0)
    class_w = np.concatenate([p["class_w"], p["class_b"][None]])
    weights = np.concatenate([p["word_w"], p["word_b"][:, None]], axis=1)
    out = np.empty(count)
    if grads is not None:
        d_own, both, class_t = np.empty_like(h), np.zeros_like(weights), np.ascontiguousarray(p["class_w"].T)
    for a in range(0, count, ROWS):
        b = min(a + ROWS, count)
        some = own[a:b]
        at = np.arange(0, (b - a) * classes, classes) + group[a:b]
        share, sums, logs = _exponentials(some @ class_w, at)
        out[a:b] = logs
        if grads is not None:
            share *= (1 / sums)[:, None]
            share.reshape(-1)[at] -= 1
            part = some.T @ share
            grads["class_w"] += part[:n]
            grads["class_b"] += part[n]
            np.matmul(share, class_t, out=d_own[a:b])
        # the classes of these states; the first and the last may go on outside
        parts = [(c, slice(max(ends[c], a) - a, min(ends[c + 1], b) - a)) for c in range(group[a], group[b - 1] + 1) if ends[c] < ends[c + 1]]
        logits = np.empty((b - a, width), h.dtype)
        for c, rows in parts:
            np.matmul(some[rows], weights[c], out=logits[rows])
        at = np.arange(0, (b - a) * width, width) + inside[a:b]
        share, sums, logs = _exponentials(logits, at)
        out[a:b] += logs
        if grads is not None:
            share *= (1 / sums)[:, None]
            share.reshape(-1)[at] -= 1
            d_word = np.empty((b - a, n), h.dtype)
            for c, rows in parts:
                if ends[c] < a:
                    both[c] += some[rows].T @ share[rows]
                else:
                    np.matmul(some[rows].T, share[rows], out=both[c])
                np.matmul(share[rows], p["word_w"][c].T, out=d_word[rows])
            d_own[a:b] += d_word
    back = np.empty(count)
    back[order] = out
    if grads is None:
        return back, None
    grads["word_w"] += both[:, :n]
    grads["word_b"] += both[:, n]
    dh = np.empty_like(h)
    dh[order] = d_own
    return back, dh


def step(given_rz: np.ndarray, given_new: np.ndarray, h: np.ndarray, u_rz: np.ndarray, u_new: np.ndarray) -> np.ndarray:
    """The state after one step from input gates and state; of reset and update, gates and weights are halves."""
    n = h.shape[1]
    rz = h @ u_rz
    rz += given_rz
    np.tanh(rz, out=rz)
    rz *= 0.5
    rz += 0.5
    new = h @ u_new
    new *= rz[:, :n]
    new += given_new
    np.tanh(new, out=new)
    out = h - new
    out *= rz[:, n:]
    out += new
    return out


def _views(values: np.ndarray, like: Params) -> Params:
    """Arrays shaped as those of `like`, one behind the other in `values`."""
    out, at = {}, 0
    for k, v in like.items():
        out[k] = values[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the row of `table` that it is for; the commonest, the first, by a product."""
    n = table.shape[1]
    table[:COMMON] += (at == np.arange(min(COMMON, len(table)), dtype=at.dtype)[:, None]).astype(rows.dtype) @ rows
    some = np.flatnonzero(at >= COMMON)
    places = at[some, None] * np.int64(n) + np.arange(n)
    np.add.at(table.reshape(-1), places.reshape(-1), rows.take(some, axis=0).reshape(-1))


def window_gradients(
    p: Params, h: np.ndarray, seen: np.ndarray, target: np.ndarray, fresh: np.ndarray, real: np.ndarray | None = None,
    into: np.ndarray | None = None,
) -> tuple[np.ndarray, float, Params]:
    """Forward and backward through one window of steps x lanes; the state before it is given
    and gets no gradient. `fresh` marks steps that begin a document, `real` the targets that
    count, all unless given; `into` is a vector to overwrite with the gradients.

    Only the recurrence runs step by step. What does not depend on later steps is computed for
    runs of steps of about `ROWS` states. A step's numbers lie by unit and then by lane, so that
    the gates are blocks without gaps.
    """
    steps, lanes = seen.shape
    n = h.shape[1]
    if into is None:
        into = np.empty(sum(v.size for v in p.values()), h.dtype)
    into.fill(0)
    grads = _views(into, p)
    x = np.ones((steps, lanes, n + 1), h.dtype)  # a last entry of 1 for the biases
    x[:, :, :n] = p["embed"].take(seen, axis=0)
    # the gates are 0.5 + 0.5 * tanh of half their sums, and halves are exact
    half = np.where(np.arange(3 * n) < 2 * n, np.float32(0.5), np.float32(1))
    u, w = (p["u"] * half).T.copy(), (np.concatenate([p["w"], p["b"][None]]) * half).T.copy()
    kept = (~fresh).astype(h.dtype)
    whole = kept.all(axis=1).tolist()
    before, states, new = (np.empty((steps, n, lanes), h.dtype) for _ in range(3))
    gates = np.empty((steps, 3 * n, lanes), h.dtype)
    r, z, last = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
    h = np.ascontiguousarray(h.T)
    at_once = max(1, ROWS // lanes)
    runs = [slice(a, min(a + at_once, steps)) for a in range(0, steps, at_once)]
    for run in runs:
        given = np.matmul(w, x[run].transpose(0, 2, 1))
        for every, keep, old, both, rz, reset, update, old_part, given_rz, given_new, candidate, out in zip(
            whole[run], kept[run], before[run], gates[run], gates[run, : 2 * n], r[run], z[run], last[run],
            given[:, : 2 * n], given[:, 2 * n :], new[run], states[run], strict=True,
        ):
            if every:
                old[...] = h
            else:
                np.multiply(h, keep, out=old)
            np.matmul(u, old, out=both)
            rz += given_rz
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            np.multiply(reset, old_part, out=candidate)
            candidate += given_new
            np.tanh(candidate, out=candidate)
            np.subtract(old, candidate, out=out)
            out *= update
            out += candidate
            h = out
    flat_states, flat_target = states.transpose(0, 2, 1).reshape(-1, n), target.reshape(-1)
    if real is None:
        logs, d_flat = output_log_p(p, flat_states, flat_target, grads)
    else:
        at = np.flatnonzero(real)
        d_flat = np.zeros_like(flat_states)
        logs, d_flat[at] = output_log_p(p, flat_states[at], flat_target[at], grads)
    d_flat = d_flat.reshape(steps, lanes, n)
    d_x, d_w = np.empty((steps, lanes, n), h.dtype), np.zeros((3 * n, n + 1), h.dtype)
    dh, through = np.zeros((n, lanes), h.dtype), np.empty((n, lanes), h.dtype)
    for run in reversed(runs):
        d_states = d_flat[run].transpose(0, 2, 1).copy()
        rest, to_new = 1 - z[run], new[run] * new[run]
        np.subtract(1, to_new, out=to_new)
        to_new *= rest
        # slopes of reset, update and the recurrent part of the candidate in the state
        slopes = np.empty((len(rest), 3, n, lanes), h.dtype)
        np.multiply(to_new, r[run], out=slopes[:, 2])
        carried = 1 - r[run]
        carried *= last[run]
        np.multiply(carried, slopes[:, 2], out=slopes[:, 0])
        np.subtract(before[run], new[run], out=carried)
        carried *= z[run]
        np.multiply(carried, rest, out=slopes[:, 1])
        np.multiply(z[run], kept[run, None], out=carried)
        d_u = np.empty((len(rest), 3 * n, lanes), h.dtype)
        for every, keep, d, slope, d_gates, d_parts, carry in zip(
            whole[run][::-1], kept[run][::-1], d_states[::-1], slopes[::-1], d_u[::-1], d_u.reshape(slopes.shape)[::-1], carried[::-1], strict=True
        ):
            d += dh
            np.multiply(slope, d, out=d_parts)
            np.matmul(p["u"], d_gates, out=dh)
            if not every:
                dh *= keep
            np.multiply(d, carry, out=through)
            dh += through
        grads["u"] += np.matmul(before[run], d_u.transpose(0, 2, 1)).sum(axis=0)
        np.multiply(to_new, d_states, out=d_u[:, 2 * n :])
        d_w += np.matmul(d_u, x[run]).sum(axis=0)
        np.matmul(d_u.transpose(0, 2, 1), p["w"].T, out=d_x[run])
    grads["w"] += d_w[:, :n].T
    grads["b"] += d_w[:, n]
    _add_rows(grads["embed"], seen.reshape(-1), d_x.reshape(-1, n))
    return np.ascontiguousarray(h.T), -float(logs.sum()), grads


def train(p: Params, stream: np.ndarray, end: int, lanes: int = 64, window: int = 32, rate: float = 0.005) -> Params:
    """One pass of truncated backpropagation over documents laid end to end, with Adam steps.

    The stream is cut into lanes of equal length; states are carried from window to window
    and start anew after every end token. Every token after the first is a target once: the
    last lane is filled up with end tokens that do not count.
    """
    lanes = max(1, min(lanes, len(stream) // (4 * window)))
    length = -(-(len(stream) - 1) // lanes)
    if length < 1:
        return p
    weights = np.concatenate([v.reshape(-1) for v in p.values()])
    p = _views(weights, p)  # all weights in one vector, for the steps
    filled = np.full(lanes * length + 1, end, stream.dtype)
    filled[: len(stream)] = stream
    seen = filled[:-1].reshape(lanes, length).T
    target = filled[1:].reshape(lanes, length).T
    real = (np.arange(lanes * length) < len(stream) - 1).reshape(lanes, length).T
    # both averages without their constant factors, which are in the size of the steps
    first, second, g = np.zeros_like(weights), np.zeros_like(weights), np.empty_like(weights)
    h = np.zeros((lanes, p["u"].shape[0]), np.float32)
    for i, a in enumerate(range(0, length, window), 1):
        part, counted = seen[a : a + window], real[a : a + window]
        h = window_gradients(p, h, part, target[a : a + window], part == end, None if counted.all() else counted, g)[0]
        size = max(1, int(counted.sum()))
        norm = np.sqrt(float(g @ g)) / size
        shrink = np.float32(min(1.0, 0.5 / max(norm, 1e-9)) / size)
        damp = np.sqrt(0.005 / (1 - 0.995**i))
        pace, least = np.float32(0.1 * rate / (1 - 0.9**i) / damp), np.float32(1e-8 / damp)
        g *= shrink
        first *= np.float32(0.9)
        first += g
        g *= g
        second *= np.float32(0.995)
        second += g
        np.sqrt(second, out=g)
        g += least
        np.divide(first, g, out=g)
        g *= pace
        weights -= g
    return p


def log_likelihoods(p: Params, texts: list[np.ndarray], end: int, flush: int = 4_000) -> np.ndarray:
    """Natural log probability of each whole token sequence, all advanced in step, the state
    carried through to the end of each."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([texts[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    n = p["u"].shape[0]
    given = p["embed"] @ p["w"] + p["b"]
    given_rz, u_rz = given[:, : 2 * n] * np.float32(0.5), p["u"][:, : 2 * n] * np.float32(0.5)
    given_new, u_new = given[:, 2 * n :].copy(), p["u"][:, 2 * n :].copy()
    total = np.zeros(len(order))
    h = np.zeros((len(order), n), np.float32)
    seen = np.full(len(order), end)
    states, targets, owners, held = [], [], [], 0
    longest = int(sizes[0]) if len(sizes) else 0
    for t, live in enumerate(np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()):
        for a in range(0, live, ROWS):
            some = slice(a, min(a + ROWS, live))
            tokens = seen[some]
            h[some] = step(given_rz.take(tokens, axis=0), given_new.take(tokens, axis=0), h[some], u_rz, u_new)
        seen = flat.take(starts[:live] + t)
        states.append(h[:live].copy())
        targets.append(seen)
        owners.append(live)
        held += live
        if held >= flush or t + 1 == longest:
            logs, _ = output_log_p(p, np.concatenate(states), np.concatenate(targets))
            owner = np.concatenate([np.arange(k) for k in owners])
            total += np.bincount(owner, weights=logs, minlength=len(order))
            states, targets, owners, held = [], [], [], 0
    out = np.empty(len(order))
    out[order] = total
    return out
