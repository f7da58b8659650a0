"""Argument checks: a wrong parameter raises instead of doing nothing."""

from __future__ import annotations


def check_strength(t: int, n: int) -> None:
    if t < 2:
        raise ValueError(f"strength t must be at least 2, got {t}")
    if n < 2:
        raise ValueError(f"at least 2 variables are needed, got {n}")
    if n < t:
        raise ValueError(f"strength t={t} needs at least {t} variables, got {n}")


def check_at_least(name: str, value: int, least: int) -> None:
    if value < least:
        raise ValueError(f"{name} must be at least {least}, got {value}")
