"""Where links come from and go to."""
