"""Command line: python -m chronofold."""

import sys

from .api import main

sys.exit(main())
