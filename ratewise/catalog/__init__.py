"""All registered queries."""

from . import data, evaluation, files, models, texts  # noqa: F401
from .base import ORACLES, QUERIES, forget_shared  # noqa: F401
