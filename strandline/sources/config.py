"""Settings of a run."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str) -> dict:
    """A YAML or JSON file as nested dictionaries; a missing file is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}
