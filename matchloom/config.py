"""Run configuration, environment files and what remote calls are made with. Driver side only."""

from __future__ import annotations

import copy
import json
import os
import re
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from matchloom.sources.paths import exists, read_text, write_text

ROLES = ("analyzer", "generator", "judge", "planner")
CONFIG_PATH = "config/run_config.json"
REMOTE_PROVIDERS = ("openai", "openai-compatible")
DETERMINISTIC = "deterministic"

# Defaults of a run configuration.
DEFAULTS: dict[str, dict[str, Any]] = {
    "analyzer": {"provider": "openai", "model": ""},
    "generator": {"provider": "openai", "model": ""},
    "judge": {"provider": "openai", "model": ""},
    "planner": {"provider": "openai", "model": ""},
    "openai": {"base_url": None, "api_key_env": "OPENAI_API_KEY", "env_file": ".env"},
    "input_extraction": {
        "ocr_provider": "local_ocr",
        "vision_provider": "openai_vision",
        "vision_model": "",
        "ocr_languages": "eng+chi_sim",
    },
    "run_metadata": {"label": ""},
}
DEFAULT_MODEL = "gpt-5.4-mini"
DEFAULT_BASE_URL = "https://api.openai.com/v1"

# Names of the environment-file entries that override a role's model or the extraction settings.
# A deployment with prefixed names sets the prefix once.
ENV_PREFIX = os.environ.get("MATCHLOOM_ENV_PREFIX", "")


@dataclass(frozen=True)
class Endpoint:
    """Where and as what a remote provider is called."""

    provider: str
    model: str
    base_url: str
    api_key: str


def default_config() -> dict[str, dict[str, Any]]:
    return copy.deepcopy(DEFAULTS)


def normalised_config(payload: Any) -> dict[str, dict[str, Any]]:
    """Complete configuration out of a partial one; sections of the wrong kind fall back to defaults.

    Empty values become defaults, except a provider name, which is kept as given.
    """
    if not isinstance(payload, dict):
        raise ValueError("Run config payload must be a JSON object.")
    config = default_config()
    for section, fields in config.items():
        given = payload.get(section)
        if not isinstance(given, dict):
            continue
        for name, default in fields.items():
            value = given.get(name, default)
            if value is None and default is None:
                continue
            keep_empty = name == "provider"
            fields[name] = str(value) if value or keep_empty else default
    return config


def write_config(
    run_dir: str, source: str | None = None, vision_fallback: bool | None = None, ocr_languages: str | None = None
) -> str:
    """Snapshot the configuration, with command-line overrides, into the run."""
    config = default_config()
    if source is not None:
        with open(source, encoding="utf-8") as handle:
            config = normalised_config(json.load(handle))
    if vision_fallback is False:
        config["input_extraction"]["vision_provider"] = "disabled"
    if ocr_languages:
        config["input_extraction"]["ocr_languages"] = ocr_languages
    path = os.path.join(run_dir, CONFIG_PATH)
    return write_text(path, json.dumps(config, indent=2, ensure_ascii=False))


def load_config(run_dir: str) -> dict[str, dict[str, Any]]:
    path = os.path.join(run_dir, CONFIG_PATH)
    if not exists(path):
        raise FileNotFoundError(f"Missing `run_config.json` in `{os.path.dirname(path)}`. Run `ingest --run-dir {run_dir}` first.")
    return normalised_config(json.loads(read_text(path)))


#: An entry of an environment file: name, then a quoted or a plain value.
ENTRY = re.compile(r"""\s*(?:export\s+)?(?P<name>[^#=\s][^=]*?)\s*=\s*(?:(?P<mark>["'])(?P<quoted>.*)(?P=mark)|(?P<plain>.*?))\s*""")


def env_path(run_dir: str, env_file: str) -> str:
    """The first place that has the file: the working directory, then the run; else the first place."""
    places = [Path(env_file)] if os.path.isabs(env_file) else [Path.cwd() / env_file, Path(run_dir) / env_file]
    return str(next((place for place in places if place.exists()), places[0]))


def read_env(path: str) -> dict[str, str]:
    """``KEY=value`` lines; comments, ``export`` and one pair of equal quotes are understood."""
    if not os.path.exists(path):
        return {}
    entries = map(ENTRY.fullmatch, Path(path).read_text(encoding="utf-8").splitlines())
    return {e["name"]: e["plain"] if e["mark"] is None else e["quoted"] for e in entries if e}


def first_filled(*values: str | None) -> str:
    return next((value.strip() for value in values if value and value.strip()), "")


def endpoint(config: dict[str, dict[str, Any]], role: str, stage: str, run_dir: str) -> Endpoint | None:
    """Remote endpoint of a role, or None for the built-in provider. Unknown names raise.

    The model comes from the environment file, then the configuration, then the default; the key
    only from the environment file.
    """
    provider = (config[role]["provider"] or DETERMINISTIC).strip().lower()
    if provider == DETERMINISTIC:
        return None
    if provider not in REMOTE_PROVIDERS:
        raise ValueError(f"Unsupported {role} provider `{provider}` for stage `{stage}`.")
    path = env_path(run_dir, config["openai"]["env_file"])
    if not os.path.exists(path):
        raise RuntimeError(f"`{stage}` cannot call `{provider}`: there is no environment file `{path}`.")
    env = read_env(path)
    model = first_filled(
        env.get(f"{ENV_PREFIX}{role.upper()}_MODEL"), env.get("OPENAI_MODEL"), config[role]["model"], DEFAULT_MODEL
    )
    key_name = first_filled(env.get("OPENAI_API_KEY_ENV"), config["openai"]["api_key_env"])
    key = first_filled(env.get(key_name))
    if not key:
        raise RuntimeError(f"`{stage}` cannot call `{provider}` with `{model}`: `{path}` has no `{key_name}`.")
    base_url = first_filled(env.get("OPENAI_BASE_URL"), config["openai"]["base_url"], DEFAULT_BASE_URL)
    return Endpoint(provider, model, base_url, key)


@dataclass(frozen=True)
class ExtractionSettings:
    ocr_provider: str
    ocr_languages: str
    vision_provider: str
    vision: Endpoint | None


def extraction_settings(
    config: dict[str, dict[str, Any]], run_dir: str, vision_fallback: bool | None, ocr_languages: str | None
) -> ExtractionSettings:
    """How images are read: languages and model from the command line, environment file, configuration."""
    section = config["input_extraction"]
    env = read_env(env_path(run_dir, config["openai"]["env_file"]))
    enabled = section["vision_provider"] != "disabled" if vision_fallback is None else vision_fallback
    model = first_filled(env.get(f"{ENV_PREFIX}VISION_MODEL"), section["vision_model"], env.get("OPENAI_MODEL"), DEFAULT_MODEL)
    key_name = first_filled(env.get("OPENAI_API_KEY_ENV"), config["openai"]["api_key_env"])
    base_url = first_filled(env.get("OPENAI_BASE_URL"), config["openai"]["base_url"], DEFAULT_BASE_URL)
    return ExtractionSettings(
        ocr_provider=section["ocr_provider"],
        ocr_languages=first_filled(
            ocr_languages, env.get(f"{ENV_PREFIX}OCR_LANGUAGES"), section["ocr_languages"], "eng+chi_sim"
        ),
        vision_provider=section["vision_provider"] if enabled else "disabled",
        vision=Endpoint("vision", model, base_url, first_filled(env.get(key_name))) if enabled else None,
    )
