"""Re-counting as inventories arrive."""
