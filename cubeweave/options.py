"""Settings that operators read, and names that other code adds to cubes."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

#: ``arithmetic_join``: how labels meet in arithmetic; ``keep_attrs``: whether its results keep the left side's attributes.
OPTIONS: dict[str, Any] = {"arithmetic_join": "inner", "keep_attrs": True}
ALLOWED = {"arithmetic_join": ("inner", "outer", "left", "right", "exact"), "keep_attrs": (True, False)}


class set_options:  # noqa: N801
    """Sets options at once; as a context manager, until its end."""

    def __init__(self, **new: Any) -> None:
        for k, v in new.items():
            if k not in OPTIONS:
                raise ValueError(f"no option {k}")
            if v not in ALLOWED[k]:
                raise ValueError(f"{k} has to be one of {ALLOWED[k]}")
        self.before = {k: OPTIONS[k] for k in new}
        OPTIONS.update(new)

    def __enter__(self) -> set_options:
        return self

    def __exit__(self, *_: object) -> None:
        OPTIONS.update(self.before)


def get_options() -> dict[str, Any]:
    return dict(OPTIONS)


def register_accessor(name: str, kind: type | None = None) -> Callable[[type], type]:
    """A class decorator: ``cube.<name>`` becomes an instance of the class, made once for each cube."""
    if kind is None:
        from cubeweave.cube import Cube as kind  # noqa: N813

    class Accessor:
        def __init__(self, made: type) -> None:
            self.made = made

        def __get__(self, cube: Any, _: type | None = None) -> Any:
            if cube is None:
                return self.made
            slot = f"_accessor_{name}"
            if slot not in cube.__dict__:
                try:
                    cube.__dict__[slot] = self.made(cube)
                except AttributeError as wrong:
                    # As an AttributeError this would look like a missing name.
                    raise RuntimeError(f"accessor {name} can't be made") from wrong
            return cube.__dict__[slot]

    def add(made: type) -> type:
        if hasattr(kind, name):
            warnings.warn(f"accessor {name} hides an attribute of {kind.__name__}", stacklevel=2)
        setattr(kind, name, Accessor(made))
        return made

    return add
