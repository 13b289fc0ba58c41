"""Parts of conditional random fields in numpy: hashed features, linear chains, loopy message passing.

Chains of different lengths are handled together: a batch is a padded array of node scores and a vector of lengths.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Rows of a weight table.
BUCKETS = 1 << 14


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Chain:
    """Weights (BUCKETS, labels), transitions (labels, labels) and starts (labels) of a linear-chain model."""

    weights: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray

    def scores(self, nodes: list[list[int]]) -> np.ndarray:
        """Node scores from their feature buckets."""
        if not nodes:
            return np.zeros((0, self.weights.shape[1]))
        sizes = np.fromiter(map(len, nodes), np.int64, len(nodes))
        flat = np.fromiter((x for n in nodes for x in n), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)


def pad(scores: np.ndarray, lengths: list[int]) -> np.ndarray:
    """(chains, longest, labels) from the nodes of all chains in a row."""
    out = np.zeros((len(lengths), max(lengths), scores.shape[1]))
    at = 0
    for i, n in enumerate(lengths):
        out[i, :n] = scores[at : at + n]
        at += n
    return out


def viterbi(chain: Chain, scores: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """The best label sequence of each chain."""
    best, links = scores[:, 0] + chain.starts, []
    ends = [best]
    for t in range(1, scores.shape[1]):
        step = best[:, :, None] + chain.transitions
        links.append(step.argmax(axis=1))
        best = step.max(axis=1) + scores[:, t]
        ends.append(best)
    out = []
    for i, n in enumerate(lengths):
        labels = [int(ends[n - 1][i].argmax())]
        for t in range(n - 2, -1, -1):
            labels.append(int(links[t][i, labels[-1]]))
        out.append(np.array(labels[::-1]))
    return out


def fit_chain(nodes: list[list[int]], labels: list[int], lengths: list[int], kinds: int, rounds: int = 100, rate: float = 0.1, penalty: float = 1e-4, barred: np.ndarray | None = None) -> Chain:
    """Maximum likelihood by full gradients (AdaGrad) with forward and backward passes. `barred` transitions stay impossible."""
    chain = Chain(np.zeros((BUCKETS, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds))
    if barred is not None:
        chain.transitions[barred] = -1e4
    if not nodes:
        return chain
    order = np.argsort(lengths, kind="stable")
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    groups = []
    for part in np.array_split(order, max(1, len(order) // 512)):
        rows = [i for c in part for i in range(firsts[c], firsts[c] + lengths[c])]
        groups.append(([nodes[i] for i in rows], np.array([labels[i] for i in rows]), [lengths[c] for c in part]))
    total = len(nodes)
    squares = [np.full_like(x, 1e-8) for x in (chain.weights, chain.transitions, chain.starts)]
    for _ in range(rounds):
        grads = [np.zeros_like(x) for x in (chain.weights, chain.transitions, chain.starts)]
        for own, gold, sizes in groups:
            x = pad(chain.scores(own), sizes)
            count, longest, _ = x.shape
            size = np.array(sizes)
            alpha = np.zeros_like(x)
            alpha[:, 0] = x[:, 0] + chain.starts
            for t in range(1, longest):
                alpha[:, t] = log_sum(alpha[:, t - 1][:, :, None] + chain.transitions, 1) + x[:, t]
            beta = np.zeros_like(x)
            for t in range(longest - 2, -1, -1):
                inner = log_sum(chain.transitions + (x[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where((t + 1 < size)[:, None], inner, 0)
            whole = log_sum(alpha[np.arange(count), size - 1], 1)
            live = np.arange(longest) < size[:, None]
            marginal = np.exp(alpha + beta - whole[:, None, None])[live]
            expected = marginal.copy()
            expected[np.arange(len(gold)), gold] -= 1
            sizes_f = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.fromiter((b for n in own for b in n), np.int64, int(sizes_f.sum()))
            for k in range(kinds):
                grads[0][:, k] += np.bincount(flat, np.repeat(expected[:, k], sizes_f), BUCKETS)
            gold_padded = np.zeros((count, longest), np.int64)
            gold_padded[live] = gold
            for t in range(1, longest):
                on = t < size
                pair = alpha[on, t - 1][:, :, None] + chain.transitions + (x[on, t] + beta[on, t])[:, None, :] - whole[on, None, None]
                grads[1] += np.exp(pair).sum(axis=0)
                np.add.at(grads[1], (gold_padded[on, t - 1], gold_padded[on, t]), -1)
            grads[2] += np.exp(alpha[:, 0] + beta[:, 0] - whole[:, None]).sum(axis=0) - np.bincount(gold_padded[:, 0], minlength=kinds)
        for value, grad, square in zip((chain.weights, chain.transitions, chain.starts), grads, squares, strict=True):
            grad = grad / total + penalty * np.where(np.abs(value) < 1e3, value, 0)
            square += grad * grad
            value -= rate * grad / np.sqrt(square)
        if barred is not None:
            chain.transitions[barred] = -1e4
    return chain


def fit_nodes(nodes: list[list[int]], labels: list[int], kinds: int, rounds: int = 60, rate: float = 0.3, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a node-wise multinomial model: the first piece of piecewise training."""
    return fit_chain(nodes, labels, [1] * len(nodes), kinds, rounds, rate, penalty).weights


def pair_scores(pairs: np.ndarray, labels: np.ndarray, kinds: int, smoothing: float = 1.0, most: float = 4.0) -> np.ndarray:
    """Pointwise mutual information of the labels of linked nodes: the pairwise piece. pairs: (n, 2) node positions."""
    counts = np.full((kinds, kinds), smoothing / kinds)
    np.add.at(counts, (labels[pairs[:, 0]], labels[pairs[:, 1]]), 1)
    joint = counts / counts.sum()
    left, right = joint.sum(axis=1, keepdims=True), joint.sum(axis=0, keepdims=True)
    return np.clip(np.log(joint / (left * right)), -most, most)


def loopy_marginals(scores: np.ndarray, edges: np.ndarray, types: np.ndarray, tables: np.ndarray, rounds: int = 50, damping: float = 0.5, tolerance: float = 1e-3) -> np.ndarray:
    """Label marginals by sum-product message passing until no message moves more than `tolerance`.

    scores: (nodes, labels); edges: (n, 2) positions; types: the row of `tables` (types, labels, labels) of each edge.
    """
    if not len(scores):
        return scores
    belief = scores
    if len(edges):
        source, target = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        table = np.concatenate((tables[types], tables[types].transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        messages = np.zeros((len(source), scores.shape[1]))
        for _ in range(rounds):
            belief = scores.copy()
            np.add.at(belief, target, messages)
            new = log_sum((belief[source] - messages[back])[:, :, None] + table, 1)
            new -= log_sum(new, 1)[:, None]
            moved = np.abs(new - messages).max()
            messages = damping * messages + (1 - damping) * new
            if moved < tolerance:
                break
        belief = scores.copy()
        np.add.at(belief, target, messages)
    return np.exp(belief - log_sum(belief, 1)[:, None])
