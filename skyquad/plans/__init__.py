"""Search plans: which sky areas to try, in which order, and the staged search itself."""
