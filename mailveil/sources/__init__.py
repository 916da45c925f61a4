"""Where mail comes from and where results go."""
