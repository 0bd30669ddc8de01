"""Where rows come from: directory trees, git repositories, configuration files, Java and JavaScript sources."""
