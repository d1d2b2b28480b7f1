"""Languages of whole files."""

from __future__ import annotations

from srcloom.operators.files import assemble, suffix

#: Language by suffix of the path; the language column of chunks can be null or 'unknown'.
SUFFIX_LANGUAGE = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "json": "json", "md": "markdown", "yml": "yaml", "yaml": "yaml"}

__all__ = ["SUFFIX_LANGUAGE", "assemble", "suffix"]
