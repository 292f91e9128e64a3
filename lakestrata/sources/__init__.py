"""Where packs and logs come from and go to."""
