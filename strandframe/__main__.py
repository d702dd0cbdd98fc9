import sys

from strandframe.cli import main

sys.exit(main())
