import sys

from tidewatch.cli import main

sys.exit(main())
