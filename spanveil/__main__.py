import sys

from .job import main

sys.exit(main())
