"""Checks of scalar parameters, shared by the operators that take them. NaN fails each of them."""

from __future__ import annotations


def above(name: str, value: float, floor: float = 0.0) -> float:
    if value > floor:
        return value
    raise ValueError(f"{name}={value!r} is not above {floor:g}")


def at_least(name: str, value: float, floor: float = 0.0) -> float:
    if value >= floor:
        return value
    raise ValueError(f"{name}={value!r} is below {floor:g}")


def share(name: str, value: float) -> float:
    """A number above zero, up to one."""
    if 0.0 < value <= 1.0:
        return value
    raise ValueError(f"{name}={value!r} is outside (0, 1]")


def choice(name: str, value: str, known: tuple[str, ...]) -> str:
    if value in known:
        return value
    raise ValueError(f"{name}={value!r} is none of {', '.join(known)}")
