"""Index configuration and its JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace


class ConfigError(ValueError):
    """A configuration that cannot be used."""


class PrefixFieldNotIndexed(ConfigError):
    """A prefix field is not among the indexed fields."""


@dataclass(frozen=True)
class IndexConfig:
    """Which fields of a document are indexed, stored and expanded.

    initials_max_len is the longest run of initial consonants that can be searched; 0 turns them off. stopwords are
    compared with whole lower-cased tokens, at index time only.
    """

    indexed_fields: tuple[str, ...] = ("title",)
    metadata_fields: tuple[str, ...] = ()
    url_field: str = "url"
    prefix_fields: tuple[str, ...] = ("title",)
    initials_max_len: int = 3
    stopwords: tuple[str, ...] | None = None

    def checked(self) -> IndexConfig:
        if missing := [f for f in self.prefix_fields if f not in self.indexed_fields]:
            raise PrefixFieldNotIndexed(f"prefix fields that aren't indexed: {', '.join(missing)}")
        if not 0 <= self.initials_max_len <= 255:
            raise ConfigError(f"initials_max_len must be from 0 to 255, not {self.initials_max_len}")
        return self

    @classmethod
    def from_json(cls, text: str, base: IndexConfig | None = None) -> IndexConfig:
        """Settings of a JSON object over those of `base`.

        A root that isn't an object changes nothing, and neither do entries of a wrong type; list items that aren't
        strings become empty strings. The length of initials is applied after the switch, so it turns them on again.
        Text that isn't JSON raises ConfigError.
        """
        config = base or cls()
        try:
            root = json.loads(text)
        except (TypeError, ValueError) as e:
            raise ConfigError(f"not JSON: {e}") from e
        section = lambda name: s if isinstance(root, dict) and isinstance(s := root.get(name), dict) else {}
        schema, korean = section("schema"), section("korean")
        changes: dict = {
            name: tuple(x if isinstance(x, str) else "" for x in schema[name]) for name in ("indexed_fields", "metadata_fields", "prefix_fields") if isinstance(schema.get(name), list)
        }
        if isinstance(schema.get("url_field"), str):
            changes["url_field"] = schema["url_field"]
        if korean.get("choseong_search") is False:
            changes["initials_max_len"] = 0
        if type(length := korean.get("choseong_max_len")) is int:
            changes["initials_max_len"] = length
        return replace(config, **changes)
