"""Errors with a code and a context that can be written as JSON; all are ValueErrors, so callers need not know them."""

from __future__ import annotations


class EngineError(ValueError):
    code = "engine_error"

    def __init__(self, message: str, *, context: dict | None = None):
        super().__init__(message)
        self.message, self.context = message, dict(context or {})

    def to_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "context": self.context}


class ConfigurationError(EngineError):
    """Options that are unknown, out of range or do not fit together."""

    code = "configuration_error"


class RoleError(EngineError):
    """Data in a role that it must not have, or in two."""

    code = "role_error"


class ManifestError(EngineError):
    """A manifest that cannot be read as one."""

    code = "manifest_error"


class IntegrityError(EngineError):
    """Content that is not what was recorded."""

    code = "integrity_error"
