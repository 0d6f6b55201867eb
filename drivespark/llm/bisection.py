"""Recursive graph bisection: an order of documents in which those that share terms lie close together.

Each document set is halved, and documents change sides in pairs as long as that lowers the estimated cost of the gaps in
the terms' lists, sum over terms of deg log2(n / (deg + 1)) on both sides; then each half is halved in turn. The tree is
fitted on a bounded sample; every document then goes down it, to the side on which its terms are cheaper, so the leaf's
number is its place in the order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Swapping rounds for each set at most, and documents of the sample in a leaf at least.
ROUNDS, LEAST = 12, 16


@dataclass
class Tree:
    """``weight[node, term]``: what a term says for the left side of a node; nodes are numbered as in a heap, from 0."""

    levels: int
    weight: np.ndarray

    def leaves(self, doc: np.ndarray, term: np.ndarray, n_docs: int) -> np.ndarray:
        """The leaf, from left to right, of each of ``n_docs`` documents, whose terms are given as pairs."""
        node = np.zeros(n_docs, np.int64)
        for _ in range(self.levels):
            left = np.bincount(doc, self.weight[node[doc], term], n_docs) > 0
            node = 2 * node + np.where(left, 1, 2)
        return node - (2**self.levels - 1)


def fit_tree(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, levels: int) -> Tree:
    """A tree of at most ``levels`` levels, from the (document, term) pairs of a sample (each pair once, by document)."""
    while levels and n_docs >> levels < LEAST:
        levels -= 1
    tree = Tree(levels, np.zeros((2**levels - 1, n_terms), np.float32))
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    members = {0: np.arange(n_docs)}
    for node in range(2**levels - 1):
        own = members.pop(node)
        size = first[own + 1] - first[own]
        at = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        local, terms = np.unique(term[at], return_inverse=True)
        right = _halves(np.repeat(np.arange(len(own)), size), terms, len(own), len(local))
        side = _degrees(np.repeat(right, size), terms, len(local))
        n = np.maximum(np.bincount(right.astype(np.int64), minlength=2), 1)
        tree.weight[node, local] = np.log2((side[0] + 1) / n[0]) - np.log2((side[1] + 1) / n[1])
        members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return tree


def _degrees(right: np.ndarray, terms: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """How many documents of the left and of the right side hold each term."""
    of_right = np.bincount(terms[right], minlength=n_terms)
    return np.bincount(terms, minlength=n_terms) - of_right, of_right


def _halves(doc: np.ndarray, terms: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Which documents go to the right half."""
    right = np.arange(n_docs) >= (n_docs + 1) // 2
    n = np.maximum(np.array([(~right).sum(), right.sum()]), 1)
    cost = lambda deg, size: deg * np.log2(size / np.maximum(deg + 1.0, 1.0))
    for _ in range(ROUNDS):
        a, b = _degrees(right[doc], terms, n_terms)
        now = cost(a, n[0]) + cost(b, n[1])
        to_right = now - cost(a - 1, n[0]) - cost(b + 1, n[1])
        to_left = now - cost(a + 1, n[0]) - cost(b - 1, n[1])
        gain = np.bincount(doc, np.where(right[doc], to_left[terms], to_right[terms]), n_docs)
        lefts, rights = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (~right, right))
        pairs = min(len(lefts), len(rights))
        swap = gain[lefts[:pairs]] + gain[rights[:pairs]] > 0
        if not swap.any():
            break
        right[lefts[:pairs][swap]], right[rights[:pairs][swap]] = True, False
    return right
