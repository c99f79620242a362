"""Thresholds of the statement engine, with overrides from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    two_up_page_width: float = 700.0
    overlap_dedup: float = 0.55
    sliver_max_width: float = 100.0
    recon_head_max_start: int = 40
    recon_head_max_len: int = 95
    recon_min_anchor_words: int = 3
    tol_pl: float = 2.0
    tol_bs: float = 2.0
    tol_cashflow: float = 200.0
    tol_equity: float = 5.0
    prose_row_ratio: float = 0.30
    prose_min_words: int = 7
    max_year_gap: int = 2
    health_bad_below: float = 0.75
    figure_outlier_sd: float = 4.0
    page_render_scale: float = 2.0
    scanned_chars_per_page: int = 90


def from_toml(path: str) -> Config:
    """Unknown keys are ignored."""
    with open(path, "rb") as f:
        read = tomllib.load(f)
    known = {x.name for x in fields(Config)}
    return replace(Config(), **{k: v for k, v in read.items() if k in known})


DEFAULT = Config()
