"""DataFrame operators. No actions inside except the bounded ones named in each docstring."""
