import sys

from inkspan.cli import main

sys.exit(main())
