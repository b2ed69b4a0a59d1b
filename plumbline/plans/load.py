"""Plug-ins: modules of a folder or a package that register models and annotators when imported."""

from __future__ import annotations

import importlib
import importlib.util
import pkgutil
import sys
from pathlib import Path


def load_plugins(folder: str) -> list[str]:
    """Import every module of a folder, in order of names."""
    names = []
    for p in sorted(Path(folder).glob("*.py")):
        name = f"plumbline_plugin_{p.stem}"
        spec = importlib.util.spec_from_file_location(name, p)
        module = importlib.util.module_from_spec(spec)
        sys.modules[name] = module
        spec.loader.exec_module(module)
        names.append(name)
    return names


def load_namespace(package: str) -> list[str]:
    """Import a package and all modules below it."""
    top = importlib.import_module(package)
    found = [m.name for m in pkgutil.walk_packages(getattr(top, "__path__", []), f"{package}.")]
    for name in found:
        importlib.import_module(name)
    return found
