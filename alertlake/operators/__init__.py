"""DataFrame -> DataFrame operators; column names are arguments, there is no global state."""
