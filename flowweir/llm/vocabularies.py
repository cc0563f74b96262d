"""Where the vocabularies of public tokenizers are."""

from __future__ import annotations

from pathlib import Path


def vocabulary(name: str, folder: str | None = None) -> str:
    """Text of a vocabulary file in ``folder``, by default that of the installed package.

    The driver reads it once and ships it with the plan: executors need no file.
    """
    if folder is not None:
        return Path(folder, name).read_text()
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()
