"""Ordered folds: games and programs replayed one group at a time.

A move changes what later moves may do, so each game is folded in order inside
one task; games are independent and spread over the cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

REGIONS = 16
FINEST = 2
POUR = 4
POURS = 16
UNLOCK = 64


class Board:
    """Sixteen depths bought with poured signal; finer depths unlock once enough evidence is banked."""

    def __init__(self):
        self.depth = [0] * REGIONS
        self.signal = self.spent = self.pours = self.banked = 0

    def play(self, kind: str, region: int = 0) -> str | None:
        """Apply a move; the reason, if it is refused."""
        if kind == "pour":
            if self.pours >= POURS:
                return "pours exhausted"
            self.signal += POUR
            self.pours += 1
            self.banked += POUR * sum(d >= 1 for d in self.depth)
            return None
        if not 0 <= region < REGIONS:
            return "off board"
        d = self.depth[region]
        if kind == "keep":
            return None
        if kind == "merge":
            if d == 0:
                return "already coarsest"
            self.depth[region] -= 1
            return None
        cost = 2**d
        if d >= FINEST:
            return "already finest"
        if d == 1 and self.banked < UNLOCK:
            return "phase locked"
        if self.signal < cost:
            return "no signal"
        self.depth[region] += 1
        self.signal -= cost
        self.spent += cost
        return None


def replay_boards(moves: DataFrame) -> DataFrame:
    """moves: game, seq, kind (pour, split, merge, keep), region. The final board and refusals of each game."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        board, refused = Board(), 0
        for kind, region in pdf.sort_values("seq")[["kind", "region"]].itertuples(index=False):
            refused += board.play(kind, int(region)) is not None
        return pd.DataFrame({"game": [key[0]], "depth_sum": [sum(board.depth)], "signal": [board.signal], "spent": [board.spent], "pours": [board.pours], "banked": [board.banked], "refused": [refused]})

    kind = moves.schema["game"].dataType.simpleString()
    return moves.groupBy("game").applyInPandas(run, f"game {kind}, depth_sum long, signal long, spent long, pours long, banked long, refused long")


def fold_loom(n: int, program) -> list:
    """Leaves 0..n-1 folded by pairs (i, j): both leave the row, their branch joins its end; bad pairs change nothing."""
    loom: list = list(range(n))
    for i, j in program:
        if i != j and 0 <= i < len(loom) and 0 <= j < len(loom):
            low, high = min(i, j), max(i, j)
            branch = (loom[low], loom[high])
            loom = [x for k, x in enumerate(loom) if k not in (low, high)] + [branch]
    return loom


def replay_looms(folds: DataFrame, leaves: int) -> DataFrame:
    """folds: game, seq, i, j. Remaining nodes and the deepest branch of each loom."""

    def depth(node) -> int:
        deepest, stack = 0, [(node, 0)]
        while stack:
            x, k = stack.pop()
            deepest = max(deepest, k)
            if isinstance(x, tuple):
                stack += [(x[0], k + 1), (x[1], k + 1)]
        return deepest

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        loom = fold_loom(leaves, zip(pdf["i"].tolist(), pdf["j"].tolist()))
        return pd.DataFrame({"game": [key[0]], "nodes": [len(loom)], "depth": [max(map(depth, loom))]})

    kind = folds.schema["game"].dataType.simpleString()
    return folds.groupBy("game").applyInPandas(run, f"game {kind}, nodes long, depth long")
