"""``python -m wagelens ...`` runs the command line (see :mod:`wagelens.cli`)."""

from .cli import main

main()
