import sys

from halyard.cli import main

sys.exit(main())
