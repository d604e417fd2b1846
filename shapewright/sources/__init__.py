"""Where captures come from."""
