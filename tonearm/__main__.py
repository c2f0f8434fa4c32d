import sys

from tonearm.cli import main

sys.exit(main())
