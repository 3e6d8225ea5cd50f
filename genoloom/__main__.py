from genoloom.cli import main

main()
