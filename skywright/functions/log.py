"""Logging of the driver and of worker tasks, through Python's logging."""

from __future__ import annotations

import logging

_LOGGER = logging.getLogger("skywright")


def log_info(message: str) -> None:
    _LOGGER.info(message)


def log_warning(message: str) -> None:
    _LOGGER.warning(message)


def log_error(message: str) -> None:
    _LOGGER.error(message)
