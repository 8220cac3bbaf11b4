"""Plans that combine several operators, and builders of test inputs."""
