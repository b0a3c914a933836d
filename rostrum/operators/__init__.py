"""DataFrame -> DataFrame operators; all are lazy unless their docstring says otherwise."""
