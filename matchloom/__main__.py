from matchloom.cli import main

raise SystemExit(main())
