"""Errors with a code, a path to the offending value, and details."""

from __future__ import annotations


class FeatureError(Exception):
    code = "error"

    def __init__(self, message: str, path: str = "", **details) -> None:
        super().__init__(message)
        self.path, self.details = path, details


class ConfigurationError(FeatureError, ValueError):
    code = "invalid_configuration"


class InputError(FeatureError, ValueError):
    code = "invalid_input"


class UnsupportedPeriodicityError(InputError):
    code = "unsupported_periodicity"


class UnsupportedDeviceError(ConfigurationError):
    code = "unsupported_device"
