import sys

from docweft.api import main

sys.exit(main(sys.argv[1:]))
