"""Settings of a run: a small YAML subset, with defaults; unknown keys are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# The media files that a scan takes unless told otherwise.
EXTENSIONS = ("mkv", "mp4", "avi", "mov", "m4v", "wmv", "flv", "webm", "ts", "m2ts", "mpg", "mpeg", "vob")


class ConfigError(ValueError):
    """What is wrong, and in which line."""


@dataclass(frozen=True)
class Target:
    codec: str = "hevc"
    quality: int = 20
    preset: str = "slow"
    max_width: int = 3840
    max_height: int = 2160
    max_bitrate_kbps: int = 0
    container: str = "mkv"
    audio_codec: str = "copy"
    subtitle_codec: str = "copy"


@dataclass(frozen=True)
class Config:
    target: Target = field(default_factory=Target)
    media_extensions: tuple[str, ...] = EXTENSIONS
    output_dir: str | None = None
    skip_ambiguous_audio: bool = False
    overwrite: bool = True
    dry_run: bool = False
    min_duration: float = 1.0
    jobs: int = 0
    probe_timeout: float = 30.0


_TRUE, _FALSE = {"true", "yes", "on", "1"}, {"false", "no", "off", "0"}


def _value(text: str, kind: type, line: int):
    try:
        if kind is bool:
            low = text.lower()
            if low not in _TRUE | _FALSE:
                raise ValueError
            return low in _TRUE
        return kind(text)
    except ValueError:
        raise ConfigError(f"line {line}: expected {kind.__name__}, got {text!r}") from None


def parse(text: str) -> Config:
    """A config of ``target:`` (indented keys), ``media_extensions:`` (dashes) and
    scalar keys. Comments start with ``#``; values may be quoted."""
    kinds = {f.name: type(f.default) for f in fields(Target)}
    target: dict = {}
    extensions: list[str] = []
    rest: dict = {}
    section = ""
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        inner = line.strip()
        if inner.startswith("- "):
            if section == "media_extensions":
                extensions.append(inner[2:].strip().strip("'\"").lstrip(".").lower())
            continue
        key, colon, value = inner.partition(":")
        if not colon:
            raise ConfigError(f"line {n}: expected 'key: value', got {inner!r}")
        key, value = key.strip(), value.strip().strip("'\"")
        if line[0] not in " \t":
            section = key if not value else ""
            if key == "output_dir":
                rest[key] = value or None
            elif key == "skip_ambiguous_audio" and value:
                rest[key] = _value(value, bool, n)
        elif section == "target" and key in kinds:
            target[key] = _value(value, kinds[key], n)
    return replace(Config(target=Target(**target)), **rest, **({"media_extensions": tuple(extensions)} if extensions else {}))
