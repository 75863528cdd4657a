import sys

from echofold.cli import main

sys.exit(main())
