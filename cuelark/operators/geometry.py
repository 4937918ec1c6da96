"""Rectangles as fractions of other rectangles, resolved to pixels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rect:
    """Left, right, top, bottom in pixels of its canvas; fractions until ``corners``."""

    left: float
    right: float
    top: float
    bottom: float

    @classmethod
    def source(cls, width: int, height: int) -> Rect:
        """A whole frame."""
        return cls(0, width, 0, height)

    def part(self, left: float, right: float, top: float, bottom: float) -> Rect:
        """A rectangle given as fractions of this one."""
        if left > right or top > bottom:
            raise ValueError(f"rectangle is turned over: {(left, right, top, bottom)}")
        w, h = self.right - self.left, self.bottom - self.top
        return Rect(self.left + w * left, self.left + w * right, self.top + h * top, self.top + h * bottom)

    def seen_from(self, canvas: Rect) -> Rect:
        """The same rectangle where ``canvas`` is the whole picture."""
        return Rect(self.left - canvas.left, self.right - canvas.left, self.top - canvas.top, self.bottom - canvas.top)

    @property
    def corners(self) -> tuple[int, int, int, int]:
        """Whole pixels, cut off toward 0."""
        return int(self.left), int(self.right), int(self.top), int(self.bottom)

    @property
    def size(self) -> tuple[int, int]:
        return int(self.right - self.left), int(self.bottom - self.top)

    @property
    def area(self) -> int:
        w, h = self.size
        return w * h

    def cut(self, image: np.ndarray) -> np.ndarray:
        """The pixels inside, right and bottom not included."""
        left, right, top, bottom = self.corners
        return image[top:bottom, left:right]
