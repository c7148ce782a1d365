"""Every constant of the geometry phases in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """`px` is a pixel of the 4x raster, `pt` a point of the page; 4 px are 1 pt."""

    scale: float = 4.0
    binarise: int = 150
    min_area: float = 3000.0
    oversize: float = 0.25
    noise_area: float = 4000.0
    padding_px: float = 40.0
    padding_bottom_px: float = 160.0
    dropped_padding_px: float = 10.0
    line_percent: int = 95
    line_gap_px: int = 100
    line_half_px: int = 10
    dilation_px: int = 14
    nms: float = 0.4
    dedup: float = 0.6
    split_gap_px: int = 3
    split_min_pt: float = 30.0
    confidence: float = 0.5
    title_buffer_px: int = 8
    row_gap_px: float = 60.0
    recovery_px: int = 200


DEFAULT = Config()
