"""Errors of plan building, and the check of keyword arguments that every constructor shares."""

from __future__ import annotations


class PlanError(ValueError):
    """stage: where it was found (argument, mapping, plan); message: what is wrong."""

    def __init__(self, stage: str, message: str):
        super().__init__(f"[{stage}] {message}")
        self.stage, self.message = stage, message


def checked(name: str, given: dict, accepted: dict) -> dict:
    """given with defaults filled in. accepted: key -> (default or ..., type or tuple of values, least, most)."""
    if unknown := sorted(set(given) - set(accepted)):
        raise PlanError("argument", f"{name} has no key {', '.join(unknown)}; it takes {', '.join(accepted)}")
    out = {}
    for key, (default, kind, least, most) in accepted.items():
        if key not in given or given[key] is None:
            if default is ...:
                raise PlanError("argument", f"{name} needs {key}")
            out[key] = default
            continue
        value = given[key]
        if isinstance(kind, tuple) and kind and isinstance(kind[0], str):
            if value not in kind:
                raise PlanError("argument", f"{name}: {key} is one of {', '.join(kind)}, not {value!r}")
        elif kind is not None and (not isinstance(value, kind) or isinstance(value, bool) and kind is not bool):
            raise PlanError("argument", f"{name}: {key} has the wrong type, {type(value).__name__}")
        if least is not None and value < least or most is not None and value > most:
            raise PlanError("argument", f"{name}: {key} is {value}, not in [{least}, {most}]")
        out[key] = value
    return out
