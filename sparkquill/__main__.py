from sparkquill.plans.drivers import main

main()
