"""B-spline bases with even knots, and their roughness penalties."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Basis:
    """df cubic B-splines on [low, high]; cyclic ones meet at the ends. Values outside count as the nearest end."""

    low: float
    high: float
    df: int
    degree: int = 3
    cyclic: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        pieces = self.df if self.cyclic else self.df - self.degree
        width = (self.high - self.low) / pieces or 1.0
        if self.cyclic:
            u = np.mod((np.asarray(x, float) - self.low) / width, pieces)
        else:
            u = np.clip((np.asarray(x, float) - self.low) / width, 0, pieces - 1e-9)
        cell = np.floor(u).astype(int)
        u = u - cell
        # The degree + 1 splines that are live in a cell, by the recursion of Cox and de Boor on even knots.
        live = [np.ones_like(u)]
        for d in range(1, self.degree + 1):
            more = [np.zeros_like(u) for _ in range(d + 1)]
            for k, value in enumerate(live):  # spline k began d - 1 - k cells before this one and is d cells wide
                more[k] += value * (1 - u + k) / d
                more[k + 1] += value * (u + d - 1 - k) / d
            live = more
        out = np.zeros((len(u), self.df))
        for k, value in enumerate(live):
            at = (cell + k) % self.df if self.cyclic else cell + k
            out[np.arange(len(u)), at] += value
        return out

    def penalty(self, order: int = 2) -> np.ndarray:
        """Of squared differences of neighbouring coefficients."""
        D = np.eye(self.df)
        if self.cyclic:
            for _ in range(order):
                D = np.roll(D, -1, 0) - D
        else:
            D = np.diff(D, order, axis=0)
        return D.T @ D
