"""Tables of trades from files, and tables that a job keeps between its steps."""
