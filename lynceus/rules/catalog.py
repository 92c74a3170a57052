"""The built-in catalog of all line engines."""

from __future__ import annotations

from lynceus.rules import ai_code, sast, secrets
from lynceus.rules.model import Catalog

DEFAULT = Catalog(sast.RULES.rules + secrets.RULES.rules + ai_code.RULES.rules)
