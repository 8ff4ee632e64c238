from quillon.plans.commands import main

main()
