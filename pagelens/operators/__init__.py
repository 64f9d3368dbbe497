"""DataFrame -> DataFrame operators; each declares a plan and leaves the strategy to Catalyst."""
