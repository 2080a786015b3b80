"""Which function stands for which operator, read off names and docstrings.

A function stands for the operators that its docstring names in capitals, and for the one that its own name spells.
"""

from __future__ import annotations

import importlib
import inspect
import pkgutil
import re

PACKAGES = ("operators", "functions", "sources", "streaming")
#: Words that docstrings write in capitals and that name no operator.
NO_OPERATORS = frozenset("JVM HTML XML URL URI SQL UTF ASCII WRITE NAMES OPEN HANDLE-DATA UDF MD5 ISO UTC".split())
_NAME = re.compile(r"(?<![A-Za-z])(?:%|FD:|\$)?[A-Z][A-Z0-9]*(?:(?:->|[-:+*/<>=])[A-Z0-9%]+)*[?!%*+]?(?![a-z])")


def coverage() -> dict[str, list[str]]:
    """Operator name to the functions that stand for it, as module:function."""
    out: dict[str, list[str]] = {}
    for package in PACKAGES:
        root = importlib.import_module(f"framesift.{package}")
        for info in pkgutil.iter_modules(root.__path__):
            module = importlib.import_module(f"framesift.{package}.{info.name}")
            owners = [(info.name, module), *((f"{info.name}.{n}", c) for n, c in inspect.getmembers(module, inspect.isclass) if c.__module__ == module.__name__)]
            for where, owner in owners:
                for name, f in vars(owner).items():
                    if name.isupper() and type(f).__module__ == module.__name__:
                        out.setdefault(name.replace("_", "-"), []).append(f"{package}.{where}:{name}")
                    f = f.__func__ if isinstance(f, staticmethod) else f
                    if name.startswith("_") or not callable(f) or getattr(f, "__module__", module.__name__) != module.__name__:
                        continue
                    names = {m[0] for m in _NAME.finditer(f.__doc__ or "") if len(m[0]) > 1} - NO_OPERATORS
                    plain = name.strip("_").replace("_to_", "->").replace("_", "-").upper()
                    names.add(plain.removeprefix("IS-") + "?" if plain.startswith("IS-") else plain.removesuffix("-PERCENT") + "%" if plain.endswith("-PERCENT") else plain)
                    for operator in names:
                        out.setdefault(operator, []).append(f"{package}.{where}:{name}")
    return out


def markdown() -> str:
    """The coverage as a table, one row per function that stands for an operator."""
    by_place: dict[str, list[str]] = {}
    for operator, places in coverage().items():
        for place in places:
            by_place.setdefault(place, []).append(operator)
    lines = ["# Operators and the functions that stand for them", "", "Made by `python -m framesift.registry`.", "", "| function | operators |", "|---|---|"]
    for place in sorted(by_place):
        lines.append(f"| `{place}` | {', '.join(f'`{o}`' for o in sorted(by_place[place]))} |".replace("||", "\\|\\|"))
    return "\n".join(lines) + "\n"


if __name__ == "__main__":
    print(markdown(), end="")
