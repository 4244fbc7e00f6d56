"""Settings of training and prediction: a dataclass, a JSON file, and ``key=value`` overrides."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    emb_size: int = 50
    num_learner: int = 15
    num_nn: int = 10
    cls_type: int = 1  # 0: k-means, else pairwise
    cls_iter: int = 10
    emb_iter: int = 10
    label_normalize: int = 1
    eta0: float = 0.1
    lam: float = 4.0
    gamma: float = 10.0
    pred_type: int = 1  # above 0: graph search, else exact
    num_edge: int = 50
    search_eps: float = 0.0
    num_thread: int = 1
    seed: int = 0x5EED
    verbose: int = 1
    train_file: str = ""
    predict_file: str = ""
    model_file: str = ""
    result_file: str = ""
    # what other implementations fix in code
    cluster_rows: int = 6000
    top_labels: int = 10
    hash_bits: int = 0  # 0: exact weights; else weights share 2**hash_bits slots

    def clusters(self, rows: int) -> int:
        return max(1, min(rows, rows // self.cluster_rows))


_KINDS = {f.name: {"int": int, "float": float, "str": str}[f.type] for f in fields(Params)}
_ALIAS = {"lambda": "lam"}


def from_json(path: str) -> Params:
    """Known keys of an object; numbers are narrowed, unknown keys ignored, wrong kinds raise."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if not isinstance(given, dict):
        raise ValueError("settings must be a JSON object")
    out = {}
    for name, value in given.items():
        name = _ALIAS.get(name, name)
        if name not in _KINDS:
            continue
        kind = _KINDS[name]
        if isinstance(value, bool) or isinstance(value, str) != (kind is str) or not isinstance(value, (str, int, float)):
            raise ValueError(f"{name} has the wrong kind")
        out[name] = kind(value)
    return Params(**out)


def override(params: Params, arguments: Iterable[str]) -> Params:
    """Later arguments win; empty and unknown ones are skipped; a known number without ``=`` raises."""
    out = {}
    for a in arguments:
        name, eq, value = a.partition("=")
        name = _ALIAS.get(name, name)
        if name in _KINDS:
            if not eq and _KINDS[name] is not str:
                raise ValueError(f"{name} needs a value")
            out[name] = _KINDS[name](value if eq else a)
    return replace(params, **out)
