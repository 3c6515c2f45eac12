"""Policy and route configuration from YAML: built-in policies only, nothing unknown, no code."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from relaypack.operators import policies as po
from relaypack.operators.frames import Policy
from relaypack.operators.redact import DEFAULT_DETECTORS, redact
from relaypack.operators.routes import Rule


class ConfigurationError(ValueError):
    """The configuration can't be used."""


@dataclass(frozen=True)
class Config:
    policies: tuple[Policy, ...]
    rules: tuple[Rule, ...]
    on_unmatched: str = "error"
    on_multiple_match: str = "error"
    fingerprint: str = ""


def _redact(o: dict[str, Any]) -> Policy:
    o = dict(o)
    found = o.pop("detectors", o.pop("detect", DEFAULT_DETECTORS))
    return redact(found, o.pop("custom_patterns", None), **o)


def _budget(o: dict[str, Any]) -> Policy:
    o = dict(o)
    return po.budget(o.pop("max_tokens"), o.pop("strategy", o.pop("overflow", "drop_oldest")), **o)


#: name -> (settings it may have, builder)
BUILT_IN: dict[str, tuple[frozenset[str], Callable[[dict[str, Any]], Policy]]] = {
    "preserve": (frozenset({"tags", "fields"}), lambda o: po.preserve(**o)),
    "redact": (frozenset({"detect", "detectors", "custom_patterns", "stage", "max_pattern_bytes", "max_scan_bytes", "max_scan_strings", "timeout_ms"}), _redact),
    "schema": (frozenset({"required_fields", "kinds", "normalize"}), lambda o: po.required_fields(o["required_fields"], o.get("kinds", ("structured",)), normalize=o.get("normalize", True))),
    "deduplicate": (frozenset(), lambda _: po.deduplicate()),
    "select": (frozenset({"roles", "kinds", "tags"}), lambda o: po.select(**o)),
    "summarize": (frozenset({"max_tokens"}), lambda o: po.summarize(**o)),
    "budget": (frozenset({"max_tokens", "strategy", "overflow"}), _budget),
}


def check_order(chain: tuple[Policy, ...]) -> None:
    """Ranks don't fall, and nothing follows the budget; policies without a rank may not follow egress redaction or the budget."""
    last = 0
    for p in chain:
        rank = getattr(p, "rank", None)
        if last >= 50 or (rank is None and last >= 45):
            raise ConfigurationError("nothing but the budget follows egress redaction, and nothing the budget")
        if rank is not None:
            if rank < last:
                raise ConfigurationError(f"policy {getattr(p, 'name', p)} comes too late")
            last = rank


def _known(d: Any, allowed: set[str] | frozenset[str], where: str) -> dict[str, Any]:
    if not isinstance(d, dict):
        raise ConfigurationError(f"{where} must be a mapping")
    if extra := set(d) - allowed:
        raise ConfigurationError(f"{where} has unknown settings: {', '.join(sorted(map(str, extra)))}")
    return d


def build_policy(entry: Any, where: str) -> Policy:
    name, options = (entry, {}) if isinstance(entry, str) else next(iter(entry.items())) if isinstance(entry, dict) and len(entry) == 1 else (None, None)
    if name not in BUILT_IN:
        raise ConfigurationError(f"{where}: unknown policy {name!r}")
    allowed, build = BUILT_IN[name]
    try:
        return build(_known(options or {}, allowed, f"{where}.{name}"))
    except (KeyError, TypeError, ValueError) as x:
        raise ConfigurationError(f"{where}.{name}: {x}") from x


def parse(raw: Any) -> Config:
    root = _known(raw or {}, {"version", "policies", "rules", "on_unmatched", "on_multiple_match"}, "root")
    if root.get("version", 1) != 1:
        raise ConfigurationError("only version 1 is known")
    on_unmatched, on_multiple = root.get("on_unmatched", "error"), root.get("on_multiple_match", "error")
    if on_unmatched not in ("error", "warn", "pass") or on_multiple not in ("error", "first", "all"):
        raise ConfigurationError("unknown route behaviour")
    chain = tuple(build_policy(p, f"policies[{i}]") for i, p in enumerate(root.get("policies") or []))
    rules: list[Rule] = []
    for i, r in enumerate(root.get("rules") or []):
        r = _known(r, {"id", "from", "to", "policies"}, f"rules[{i}]")
        ident = r.get("id", f"rule-{i + 1}")
        if "policies" not in r or not isinstance(ident, str) or not ident.strip() or ident in {x.rule_id for x in rules}:
            raise ConfigurationError(f"rules[{i}] needs policies and an id of its own")
        rules.append(Rule(str(r.get("from", "*")), str(r.get("to", "*")), tuple(build_policy(p, f"rules[{i}].policies[{k}]") for k, p in enumerate(r["policies"] or [])), ident))
    check_order(chain)
    for r in rules:
        check_order(r.policies)
    text = json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return Config(chain, tuple(rules), on_unmatched, on_multiple, hashlib.sha256(text.encode()).hexdigest())


def load(path: str | Path) -> Config:
    import yaml

    try:
        return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    except (OSError, yaml.YAMLError) as x:
        raise ConfigurationError(f"{path} can't be read: {x}") from x
